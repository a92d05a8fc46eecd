"""Trains the tagger of ``pii`` in numpy from labelled spans: ``python -m skeinlog.llm.pii_training DATA_DIR``.

Labelled texts are made: items of known kind, built from public forms (number plans, postal habits, common names)
and from words spliced anew for every text, are put into sentences written here and into sentences of a bounded
sample (``SAMPLE``) of the ``documents`` corpus and of the questions in ``vscode_chats``, tables that by their description hold no
personal information and that no query of the problem reads. Nothing is taken from the tables in which items are looked for.
"""

from __future__ import annotations

import multiprocessing
import os
import random
import re
import sys
import time

import numpy as np

from skeinlog.llm.pii import KINDS, MODEL, SYMBOLS, WINDOW, Tagger, items

#: Most documents, and most questions, read as surroundings: those with the smallest hashes of their ids.
SAMPLE = 8000
HIDDEN, ROUNDS, STEPS, BATCH_TEXTS, WORKERS = 20, 360, 10, 80, 8

#: Common given names of several countries; fixed values.
GIVEN = """James Mary Robert Patricia Michael Jennifer William Linda David Elizabeth Richard Barbara Joseph Susan Thomas Jessica Christopher Karen Daniel Lisa Matthew Nancy Anthony
Mark Sandra Steven Ashley Andrew Emily Kenneth Michelle Kevin Amanda Brian Melissa George Deborah Hans Ursula Klaus Sabine Jürgen Heike Wolfgang Katrin Dieter Jörg Björn Lukas Mia
Pierre Camille Jean Céline François Hélène Thierry Chloé Mathieu Aurélie José Carmen Javier Lucía Andrés Pilar Álvaro Sofía Giulia Marco Francesca Lorenzo Chiara Alessandro
João Beatriz Rui Olena Dmitri Svetlana Oleg Katarzyna Piotr Agnieszka Zsófia Gábor Petra Jiří Mehmet Ayşe Fatma Mustafa Yusuf Fatima Ahmed Layla Hassan Priyanka Rahul Ananya Vikram
Wei Mei Hiroshi Keiko Takeshi Minh Thuy Kwame Amara Chinedu Ngozi Sven Astrid Lars Ingrid Mikkel Sanna Eero""".split()
#: Common family names of several countries; fixed values.
FAMILY = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thompson Moore Jackson Harris Robinson Lewis Walker Wright Campbell Mitchell Roberts Phillips Evans
Edwards Collins Stewart Murphy Cooper Richardson Howard Peterson Bailey Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Richter Klein Schröder Neumann Zimmermann
Krüger Hartmann Lehmann Martin Bernard Dubois Durand Lefèvre Moreau Girard Lambert Fontaine Rousseau García Fernández González Rodríguez López Sánchez Pérez Gómez Jiménez Ruiz Navarro
Rossi Ferrari Esposito Bianchi Colombo Ricci Silva Santos Oliveira Ferreira Kowalski Nowak Wiśniewski Novák Svoboda Horvat Nagy Kovács Ivanov Petrov Shevchenko Yılmaz Demir Kaya Hussain
Patel Sharma Iyer Banerjee Khan Nguyen Tran Kim Park Tanaka Suzuki Watanabe Chen Wang Okafor Mensah Hansen Nielsen Johansson Lindqvist Virtanen O'Brien McCarthy FitzGerald""".split()
#: Beginnings and ends of place and street names of several countries; fixed values.
PLACE_A = "Spring Green Brook Ash Wood Clear Fair Mill Kings Queens River Rock High Long Stone Oak Elm Cedar Bridge Church Han Ham Nürn Frei Würz Bam Regens Wolfs Göt Stras Nan Mont Ville Beau Saint- Val Sala Bada Carta Grana Ali Lind Berg".split()
PLACE_B = "field ford ton ville burg berg wood dale port mouth bury stead heim hausen hafen brück furt ingen bourg pellier neuve celona nova manca cante joz gena borough haven vik".split()
CITIES = "London Leeds York Bristol Boston Chicago Denver Seattle Austin Portland Berlin Hamburg München Köln Dresden Leipzig Paris Lyon Toulouse Lille Madrid Sevilla Valencia Bilbao Wien Zürich Dublin Toronto".split()
WAYS = "Street St St. Road Rd Avenue Ave Ave. Lane Ln Drive Dr Court Ct Place Boulevard Blvd Blvd. Way Terrace Close Crescent Square Parkway Gardens".split()
STATES = "AL AZ CA CO FL GA IL MA MI MN NY OH OR PA TX VA WA".split()
MAIL_WORDS = "mail post inbox web net cloud data soft tech labs group works systems office team home studio media info global".split()
MAIL_ENDS = ".com .com .com .org .net .edu .io .de .fr .es .co.uk .eu .example .test .invalid".split()
#: Common English words for titles of pages, products and features; fixed values.
TITLE_A = "Release Account Dark Light Quick Smart Global Local Shared Private Public Daily Weekly Central Remote Internal Native Golden Red Blue White Black Silver Early Late Open Closed Deep Bright Hidden Summer Winter Morning Royal New Old Big Fast".split()
TITLE_B = "Notes Settings Mode Search Login Report Editor Viewer Manager Browser Server Client Console Wizard Panel Calendar Library Guide Store Center Monitor Engine Toolkit Platform Sky Ocean Mountain Forest Eagle Tiger Garden Stream Castle Market Hall House Valley Lake Road Bridge Desk Pipeline Backlog Sprint Roadmap".split()
TOOLS = "pytest make tmux git docker bazel tox gradle ruff eslint cargo mypy npm yarn pip helm kubectl terraform rsync curl ssh".split()
THINGS = "invoice parser backup server build deployment contract schema client review ticket order account import export meeting release parcel form refund cron job".replace("cron job", "cronjob").split()
#: Sentences around items ({N} name, {E} email, {P} phone, {I} id number, {A} address; {f} file, {w} code, {c} thing, {t} tool); fixed values.
CARRIERS = [
    "Please forward the {c} to {E}.", "Customer {N} called about the {c}, number {P}.", "{N} will review the {c} next week", "assigned to {N}", "Author: {N} <{E}>", "From: {N} <{E}>", "To: {E}", "Reviewed-by: {N} <{E}>",
    "You can phone {P} during office hours", "Tel. {P}", "phone: {P}", "mobile {P}, mail {E}", "fax {P}", "The new employee is {N} ({E})", "kind regards, {N}", "Regards,\n{N}", "Cheers {N}", "hello {N}, did you see the {c}?", "talk to {N} or {N} first",
    "{N} and {N} found the bug in {f}", "according to {N}, {w} is fine", "blame says {N} changed {f}", "her address: {A}", "send the parcel to {N}, {A}", "billing address {A}", "deliver it to {A}.", "office at {A} is closed", "He moved to {A} last year",
    "SSN {I}", "social security number {I}", "her id is {I}", "tax number: {I}", "the applicant's document {I} has expired", "record for {N}: {I}, {A}", "{N};{E};{P}", "{N}, {P}, {E}", "{I} | {N} | {P}", "name={N} phone={P}",
    "{c} was opened by {N}", "owner of {f} is {N}", "remove {E} from the list", "why is {E} in the {c}?", "the test user {E} can't log in", "mailto:{E}", "git log --author '{N}'", "git commit --author=\"{N} <{E}>\"", "export MAIL_TO={E}", "{t} --user {E}", "sendmail {E} < {f}",
    "curl -d 'phone={P}' localhost", "redact {I} in {f}", "delete the line with {A} from {f}", "the dump contains {P} and {I}", "Frau {N} wohnt in {A}", "mein Name ist {N}", "Bitte {N} anrufen: {P}", "Ansprechpartner ist {N}, E-Mail {E}", "Personalausweis {I}", "die Adresse lautet {A}", "Telefon {P}",
    "mon nom est {N}", "appelez {N} au {P}", "son adresse est {A}", "écrivez à {E}", "numéro de pièce {I}", "M. {N} a signalé le problème", "el cliente {N} vive en {A}", "llama a {N} al {P}", "mi correo es {E}", "documento {I} de {N}", "contacto: {N}, {E}",
    "I am {N}.", "This is {N} from support", "written by {N}", "{N}: looks good to me", "@{w} cc {N}", "{E}", "{P}", "{A}", "{I}", "{N}", "call me at {P} or write to {E}", "tell {N} that {w} broke", "{N} lives at {A}; phone {P}", "as discussed with {N}, the {c} moves to {f}", "ask {N}",
    "{N} says it works", "{N} opened a ticket about {w}", "{N} merged {f}", "{N} broke the build, dial {P}", "{N} asked for this; {P}", "{N} noticed that {w} fails", "{N} wants {f} back", "{N} will ship the {c}", "{N} left a note: {P}", "{N} is on call, ring {P} when {w} stops", "{N} fixed {w}", "{N} moved to {A}", "{N} sent {E}", "{N} here, {w} fails", "{N} is out until {M}",
    "Signed: {N} {E}", "{N} et {N}", "{N} a écrit {w}", "{N} hat {w} geändert", "{N} cambió {w}", "{N} demande {P}", "{N} / {E} / {P}", "{P} / {N}", "{E} and {E}", "mail {E} or {E}", "{E}, {E}", "{P} or {P}", "{P} and {P}", "{I} and {I}", "{N} and {N}", "{N}, {N} and {N}", "both {A} and {A}", "{I}, {P}", "{P}; {I}", "{I} / {P} / {E}", "id {I}, tel {P}", "not {P} but {P}", "{E} or {P}", "user.name={N} user.email={E}", "--name \"{N}\" --mail {E}",
]
#: Sentences that hold none; fixed values.
NOTHING = [
    "git clone git@{h}.{k}:{w}/{w}.git", "git@{k}{T}:{w0}/{w0}.git", "fetch git@{k}.{k}{T}:{w0}/{h}.git", "origin git@{w0}{T}:{k}/{k}.git is gone", "ssh://git@{k}{T}/{w0}.git", "{w0}@{k}{T}:/{w0}/{w0}", "{d}-{d}-{d}", "{d}-{d}", "lines {d}-{d}-{d} of {f}", "slice {d}-{D}", "{d}.{d}.{d}.{d}", "{d}/{d}/{d}", "git remote add up git@{k}.org:{w}.git", "ssh {w0}@{w0}-{d}", "scp {f} {w0}@{h}:/srv/{w0}", "{w0}@{d}.{d}.{d}", "npm i {w0}@{d}.{d}.{D}", "@{w0} def {w}", "pip install {w0}=={d}.{d}.{d}", "from {f} import {w}", "@{w0}/{w0}@{d}.{d}",
    "10.{d}.{d}.{d}:{D}", "127.0.0.1:{D}", "host 192.168.{d}.{d} is down", "id {u}", "trace {u} ended", "sha {x}", "commit {x} in {f}", "{Y}-{m}-{m} {m}:{m}:{m}", "{m}/{m}/{Y}", "{m}.{m}.{Y}", "on {Y}-{m}-{m} the {c} broke", "between {m}-{m}-{y} and {m}-{m}-{y}", "at {s} the {c} stopped", "epoch {s}",
    "the {G} page is slow", "{G} was renamed to {G}", "open {G}", "see the {G} board", "ship {G} first", "{G} {d}.{d} is out", "{c} {D} of {D}", "issue #{D}", "{J}-{D}", "see {J}-{h}", "line {D}, in {w}", "{f}:{D}:{d}", "took {D} ms and {D} rows", "{t} {f}", "{t} --jobs {d} {f}", "{t} run {w} && {t} push",
    "https://{h}.{k}.com/{w}?id={D}", "http://localhost:{D}/{w}", "{w}({d}, {d})", "port {D}", "v{d}.{d}.{D}", "{x}", "error {D}: {w}", "{D} of {D} passed", "order {D} items", "{c} no. {D}", "Zeile {D} in {f}", "la ligne {D} de {f}", "la línea {D} de {f}",
    "build {D}-{x}", "run {D}-{h}-{D}", "{u}.log", "key {D}-{h}{D}", "Mr. {c}", "Dear team, the {c} is ready", "I think {G} and {G} should merge", "Monday", "In {M} we ship", "{t} failed with E{D}", "PR {D} by the bot", "user {w} has {D} rows",
    "at {s}", "created {s}", "since {s} nothing", "ts={s}", "{s}", "version {d}.{d}.{D}", "to {d}.{d}.{D}", "{t} {d}.{d}.{D} is out", "from {d}.{d} to {d}.{D}", "{w} fails", "{w} calls {w}", "{w} in {f} is slow", "{w0} and {w}", "{w}: done",
    "Can you check {w}?", "Could you split {f} in two?", "Would it be better to drop {w}?", "Where is {w} used?", "Kannst du {w} prüfen?", "Könntest du {f} aufteilen?", "Wo wird {w} benutzt?", "Warum ist {w} so langsam?", "Weshalb braucht {f} {D} Zeilen?", "Pourquoi {w} est-elle si lente ?", "Peux-tu vérifier {f} ?",
    "Quand faut-il lancer {t} ?", "¿Puedes revisar {w}?", "¿Por qué tarda {f}?", "¿Dónde se usa {w}?", "Zeig mir {f}", "Montre-moi {f}", "Muéstrame {f}", "Explain {w}", "Fix {w}, then {t}", "yes", "no", "go on", "thanks", "Danke", "merci", "gracias", "ok, next",
    "Die Rechnung liegt im Ordner.", "Der Vertrag gilt ab {M}", "Unser Lager ist voll", "Die Nummer steht im Formular", "Das Formular hat {D} Felder", "Der Kunde wartet auf die Lieferung", "Im Keller steht der alte Server", "Die Abteilung plant einen Umzug", "Meine Kundennummer fehlt: siehe {f}", "Der Antrag vom Montag ist fertig",
    "La réunion de lundi est annulée", "Le contrat et la facture sont dans {f}", "El pedido llegó el lunes", "La factura y el contrato faltan", "ISO {D}-{d}", "POSIX {D}.{d}", "{J} {D}", "{J} {D} part {d}", "The {G} hides the {G} on phones", "the {G} covers {c} and {c}", "see chapter {d}.{d}.{d}", "a + {w}.{w0}", "{w0}.{w0}.{k} is down", "class {G2}({G2})", "return {G2}({w}, {d})", "public {G2} {w}()", "void {w}({G2} {k})",
]


class Maker:
    """Makes labelled texts; every draw comes from one seed."""

    def __init__(self, seed: int, around: list[str]) -> None:
        self.r = random.Random(seed)
        self.around = around or ["please run the tests again"]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, most: int = 3) -> str:
        return "".join(self.r.choice("bcdfghjklmnprstvwxz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, most))) + self.r.choice(["", "", "n", "r", "s", "x"])

    def spliced(self, words: list[str]) -> str:
        """The beginning of one word with the end of another: a new word of the same make."""
        r = self.r
        a, b = r.choice(words), r.choice(words)
        i, j = r.randint(2, max(2, len(a) - 2)), r.randint(1, max(1, len(b) - 3))
        return (a[:i] + b[j:].lower()) if r.random() < 0.8 else a + b[j:].lower()

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.55 else self.spliced(GIVEN)

    def family(self) -> str:
        r = self.r
        one = lambda: r.choice(FAMILY) if r.random() < 0.3 else self.spliced(FAMILY) if r.random() < 0.6 else self.spliced(FAMILY + PLACE_A) + r.choice(PLACE_B) if r.random() < 0.7 else self.word().capitalize()
        return one() + ("-" + one() if r.random() < 0.14 else "")

    def name(self) -> str:
        r, given, family = self.r, self.given(), self.family()
        form = r.random()
        if form < 0.5:
            text = f"{given} {family}"
        elif form < 0.62:
            text = f"{given} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {family}"
        elif form < 0.66:
            text = f"{given} {r.choice(['van', 'de', 'von', 'della', 'al', 'Al', 'El'])}{r.choice([' ', '-'])}{family}"
        elif form < 0.8:
            text = f"{family}, {given}"
        elif form < 0.84:
            text = f"{r.choice('ABCDEGHJKLMNPRST')}. {family}"
        else:
            text = f"{r.choice(['Ms', 'Ms.', 'Mr', 'Mr.', 'Dr.', 'Dr', 'Mrs', 'Prof.', 'Herr', 'Frau', 'Mme', 'Sra.'])} {family}"
        return text.upper() if r.random() < 0.1 else text.lower() if r.random() < 0.03 else text

    def host(self) -> str:
        r = self.r
        name = lambda: r.choice([r.choice(MAIL_WORDS), self.word(), self.spliced(FAMILY + PLACE_A).lower(), r.choice(MAIL_WORDS) + self.word(2), self.word(2) + r.choice(MAIL_WORDS)])
        plain = re.sub(r"[^a-z0-9.-]", "", (name() + ("." + name() if r.random() < 0.25 else ("-" + name() if r.random() < 0.08 else ""))).lower())
        return (plain or "mail") + r.choice(MAIL_ENDS)

    def email(self) -> str:
        r = self.r
        simple = lambda s: re.sub(r"[^a-z]", "", s.lower().translate(str.maketrans("éèëöüäóíáçşñø", "eeeouaoiacsno"))) or "user"
        a, b = simple(self.given()), simple(self.family())
        who = r.choice([a, b, a + b, a + "." + b, a + "_" + b, a + "-" + b, a[0] + b, a[0] + "." + b, b + "." + a, a + "+" + self.word(2), a + b[0]])
        who += self.digits(r.randint(1, 4)) if r.random() < 0.35 and "+" not in who else ""
        host = self.host()
        form = r.random()
        if form < 0.74:
            text = f"{who}@{host}"
            return text.upper() if r.random() < 0.1 else text
        at = r.choice([" [at] ", " (at) ", "[at]", "(at)", " at ", " AT ", " @ "])
        dot = r.choice([".", ".", " dot ", "[dot]", " [dot] ", "(dot)"]) if at != " at " else " dot "
        return who + at + host.replace(".", dot)

    def phone(self) -> str:
        """Written forms of national and international number plans."""
        r, d = self.r, self.digits
        a, x = str(r.randint(201, 989)), str(r.randint(200, 999))
        z = str(r.randint(20, 989))
        text = r.choice([
            f"+1{a}{x}{d(4)}", f"+1 ({a}) {x}-{d(4)}", f"+1-{a}-{x}-{d(4)}", f"1-{a}-{x}-{d(4)}", f"({a}) {x}-{d(4)}", f"{a}-{x}-{d(4)}", f"{a}.{x}.{d(4)}", f"{a} {x} {d(4)}", f"+1 {a} {x} {d(4)}",
            f"020 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"0{z} {d(3)} {d(4)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"+44 (0){z} {d(6)}", f"0{z}/{d(r.randint(5, 8))}", f"0{z}/{d(5)}-{d(r.randint(2, 3))}", f"+49 {z} {d(r.randint(5, 8))}", f"+49 {z} {d(5)} {d(3)}", f"+49 (0){z} {d(6)}", f"0049 {z} {d(7)}",
            f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {r.choice('679')}{d(2)} {d(3)} {d(3)}", f"{r.choice('679')}{d(2)} {d(3)} {d(3)}", f"+34 {r.choice('679')}{d(2)} {d(2)} {d(2)} {d(2)}",
            f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"+{r.randint(20, 99)}{d(r.randint(8, 10))}", f"03-{d(4)}-{d(4)}",
        ])
        return text + (r.choice([" ext. ", " ext ", " x"]) + d(r.randint(2, 4)) if r.random() < 0.1 else "")

    def id_number(self) -> str:
        """Written forms of national identity, tax, social security, passport and licence numbers."""
        r, d = self.r, self.digits
        c, letter = r.choice, "ABCDEFGHJKLMNPQRSTVWXYZ"
        two = lambda: c("ABCEGHJKLMNOPRSTWXYZQ") + c("ABCEGHJKLMNPRSTWXYZQ")
        bare = c([
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"9{d(2)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{two()}{d(6)}{c('ABCD')}", lambda: f"{two()} {d(2)} {d(2)} {d(2)} {c('ABCD')}", lambda: f"{two()}-{d(2)}-{d(2)}-{d(2)}-{c('ABCD')}",
            lambda: f"{d(8)}{c(letter)}", lambda: f"{d(8)}-{c(letter)}", lambda: f"{c('XYZ')}{d(7)}{c(letter)}", lambda: f"{c('XYZ')}-{d(7)}-{c(letter)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{c('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}",
            lambda: f"{c('CFGHJKLMNPRTVWXYZ')}{d(2)}{c('CFGHJKLMNPRTVWXYZ')}{d(5)}", lambda: "".join(c(letter) for _ in range(6)) + f"{d(2)}{c('ABCDEHLMPRST')}{d(2)}{c(letter)}{d(3)}{c(letter)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
        ])
        led = c([
            lambda: f"passport {c(letter)}{d(8)}", lambda: f"passport no. {two()}{d(7)}", lambda: f"Passport No {d(9)}", lambda: f"passport number {c(letter)}{d(7)}", lambda: f"passport {two()}{d(6)}", lambda: f"driver's license {c(letter)}{d(7)}", lambda: f"driver licence {c(letter)}{d(3)}-{d(4)}-{d(4)}", lambda: f"driving licence {c(letter)}{d(4)}-{d(5)}-{d(5)}",
            lambda: f"Steuer-ID {d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"Steuer-ID {d(11)}", lambda: f"DNI {d(8)}{c(letter)}", lambda: f"NIE {c('XYZ')}{d(7)}{c(letter)}", lambda: f"SSN {d(3)}-{d(2)}-{d(4)}", lambda: f"NI number {two()}{d(6)}{c('ABCD')}", lambda: f"Ausweisnr. {c('LMNPRT')}{d(2)}{c('FGHJK')}{d(5)}",
            lambda: f"licence no. {c(letter)}{d(8)}", lambda: f"tax id {d(2)}-{d(7)}", lambda: f"ID card {two()} {d(7)}", lambda: f"CPF {d(3)}.{d(3)}.{d(3)}-{d(2)}",
        ])
        return (bare if r.random() < 0.55 else led)()

    def place(self) -> str:
        r = self.r
        made = r.choice(PLACE_A) + r.choice(PLACE_B)
        return r.choice(CITIES) if r.random() < 0.3 else re.sub(r"-(\w)", lambda m: "-" + m[1].upper(), made) if r.random() < 0.7 else r.choice(["San ", "Bad ", "New ", "Low ", "Great ", "Saint-", "Sankt "]) + made.capitalize() + r.choice(["", "", "-sur-Mer", "-le-Bas", " Bay"])

    def address(self) -> str:
        r, d = self.r, self.digits
        no = f"{r.randint(1, 999)}{r.choice(['', '', '', '', 'a', 'b', 'B', ' bis'])}"
        street = lambda: r.choice([self.family(), self.place(), r.choice(PLACE_A), r.choice(PLACE_A) + " " + r.choice(PLACE_A), self.spliced(PLACE_A) + r.choice(PLACE_B)]).replace("- ", " ")
        town = self.place()
        base = f"{no} {street()} {r.choice(WAYS)}"
        flat = f"{r.choice(['Apt', 'Apt.', 'Flat', 'Unit', 'Suite'])} {r.randint(1, 60)}{r.choice(['', '', 'B', 'C'])}"
        uk = f"{r.choice('BLMSEN')}{r.choice(['', 'S', 'E'])}{r.randint(1, 20)} {d(1)}{r.choice('ABDEFGH')}{r.choice('JLNPQR')}"
        german = r.choice([self.spliced(PLACE_A) + r.choice(["straße", "str.", "weg", "allee", "gasse", "platz"]), self.family() + "straße", self.place() + r.choice(["er Straße", "er Weg", "er Allee"]), r.choice(["Am ", "An der ", "Im ", "Auf dem ", "Zum "]) + self.spliced(PLACE_A).capitalize()])
        french = r.choice(["rue", "avenue", "boulevard", "place", "impasse", "allée", "chemin", "quai"]) + r.choice([" de ", " des ", " du ", " de la ", " "]) + r.choice([self.family(), self.place(), self.spliced(PLACE_A).capitalize() + "s"])
        spanish = r.choice(["Calle", "Calle de", "Calle del", "C/", "Avenida", "Avenida de", "Plaza", "Paseo de"]) + " " + r.choice([self.family(), self.place()])
        return r.choice([
            lambda: base, lambda: f"{base}, {town}", lambda: f"{base}, {town}, {r.choice(STATES)} {d(5)}", lambda: f"{base}, {town} {d(5)}", lambda: f"{base}, {flat}, {town}, {r.choice(STATES)} {d(5)}", lambda: f"{flat}, {base}, {town} {d(5)}", lambda: f"{flat}, {base}, {town}", lambda: f"{base}, {town} {uk}", lambda: f"{base} {flat}",
            lambda: f"{german} {no}, {d(5)} {town}", lambda: f"{german} {no}, {d(5)} {town}", lambda: f"{german} {no} in {d(5)} {town}", lambda: f"{german} {no}", lambda: f"{no}{r.choice([' ', ', '])}{french}, {d(5)} {town}", lambda: f"{no} {french}, {town}", lambda: f"{no} {french}",
            lambda: f"{spanish} {r.randint(1, 200)}, {r.randint(1, 9)}º {r.choice('ABCD')}, {town}", lambda: f"{spanish}, {r.randint(1, 200)}, {d(5)} {town}", lambda: f"{spanish} {r.randint(1, 200)}, {d(5)} {town}", lambda: f"{spanish} {r.randint(1, 200)}, {town}", lambda: f"{r.choice(['PO Box', 'P.O. Box', 'Postfach'])} {r.randint(10, 9999)}, {town}", lambda: f"{r.choice(['PO Box', 'P.O. Box'])} {r.randint(10, 9999)}, {town} {d(5)}",
        ])()

    def filler(self, code: str) -> str:
        r, d = self.r, self.digits
        h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        title = lambda: f"{r.choice(TITLE_A)} {r.choice(TITLE_B)}" if r.random() < 0.7 else f"{r.choice(TITLE_B)} {r.choice(TITLE_B)}"
        return {
            "f": lambda: f"{r.choice(['src', 'pkg', 'lib', 'core', 'app', 'cmd', 'tests', 'docs', self.word()])}/{r.choice(['', self.word() + '/'])}{self.word()}{r.choice(['', '_' + self.word(), '-v2'])}.{r.choice(['py', 'go', 'ts', 'sql', 'rs', 'java', 'md', 'yaml', 'csv'])}",
            "w": lambda: f"{self.word()}{r.choice(['_' + self.word(), self.word().capitalize(), '', '.' + self.word()])}", "w0": lambda: r.choice([self.word(), r.choice(TOOLS), r.choice(THINGS)]), "c": lambda: r.choice(THINGS), "t": lambda: r.choice(TOOLS),
            "d": lambda: str(r.randint(0, 99)), "D": lambda: str(r.randint(100, 99999)), "u": lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", "h": lambda: h(4), "k": self.word, "x": lambda: h(r.choice([7, 12, 40])), "s": lambda: "1" + d(r.choice([9, 12])),
    "G": title, "G2": lambda: r.choice(TITLE_A + TITLE_B) + (r.choice(TITLE_B) if r.random() < 0.6 else ""), "T": lambda: r.choice(MAIL_ENDS), "J": lambda: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(r.randint(2, 4))), "Y": lambda: f"20{r.randint(10, 29)}", "y": lambda: f"{r.randint(10, 29)}", "m": lambda: f"{r.randint(1, 12):02d}", "M": lambda: r.choice(["January", "March", "July", "October"]),
        }[code]()

    def sentence(self, pattern: str) -> tuple[str, list[int]]:
        text, tags = "", []
        for part in re.split(r"(\{\w+\})", pattern):
            code = part[1:-1] if part.startswith("{") else None
            tag = 0
            if code in ("N", "E", "P", "I", "A"):
                tag = "EPIAN".index(code) + 1
                part = {"N": self.name, "E": self.email, "P": self.phone, "I": self.id_number, "A": self.address}[code]()
            elif code:
                part = self.filler(code)
            text += part
            tags += [tag] * len(part)
        return text, tags

    def woven(self) -> tuple[str, list[int]]:
        """A sentence of the corpus with an item between two of its words."""
        r = self.r
        s = r.choice(self.around)
        gaps = [m.start() for m in re.finditer(" ", s)] or [len(s)]
        at = r.choice(gaps)
        code = r.choice("NNEPPIIA")
        item, tags = self.sentence(r.choice(["{%s}", "{%s}", "({%s})", "{%s},", "'{%s}'", "{%s}:", "- {%s} -"]) % code)
        return f"{s[:at]} {item}{s[at:]}", [0] * (at + 1) + tags + [0] * (len(s) - at)

    def text(self) -> tuple[str, list[int]]:
        r = self.r
        pieces = []
        for _ in range(r.choice([1, 1, 2, 2, 3, 4])):
            kind = r.random()
            if kind < 0.26:
                pieces.append(self.sentence(r.choice(CARRIERS)))
            elif kind < 0.38:
                pieces.append(self.woven())
            elif kind < 0.56:
                pieces.append(self.sentence(r.choice(NOTHING)))
            elif kind < 0.58:
                units = [r.choice([self.word(2)[:k], self.digits(k)]) for k in (r.randint(1, 3), r.randint(1, 3))]
                s = r.choice([" ", "", "-", ", "]).join(r.choice(units) for _ in range(r.randint(4, 60))) if r.random() < 0.5 else (" ".join(units) + " ") * r.randint(3, 40)
                pieces.append((s, [0] * len(s)))
            else:
                pieces.append(((s := r.choice(self.around)), [0] * len(s)))
        glue = r.choice([" ", "\n", ". ", " - ", ".. ", "\n- ", "; ", ", "])
        text, tags = "", []
        for k, (s, t) in enumerate(pieces):
            text, tags = text + (glue if k else "") + s, tags + [0] * (len(glue) if k else 0) + t
        if r.random() < 0.2:
            text, tags = text + ".", [*tags, 0]
        if len(text) > WINDOW:
            at = r.randint(0, len(text) - WINDOW)
            text, tags = text[at : at + WINDOW], tags[at : at + WINDOW]
        return text, tags


class Trainer:
    """Forward, backward and Adam for the bidirectional LSTM with CRF."""

    def __init__(self, seed: int, hidden: int = HIDDEN) -> None:
        g = np.random.default_rng(seed)
        k = len(KINDS) + 1
        self.w = {
            "X": (g.normal(size=(2, SYMBOLS, 4 * hidden)) * 0.3).astype(np.float32), "U": (g.normal(size=(2, hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "V": (g.normal(size=(2, hidden, k)) / np.sqrt(hidden)).astype(np.float32), "b": np.zeros(k, np.float32), "A": np.zeros((k, k), np.float32),
        }
        self.w["X"][:, :, hidden : 2 * hidden] += 1.0
        self.m = {n: np.zeros_like(v) for n, v in self.w.items()}
        self.v = {n: np.zeros_like(v) for n, v in self.w.items()}
        self.steps, self.hidden = 0, hidden

    def batch(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients; ``x, y, mask`` are (time, texts), padded behind."""
        w, h = self.w, self.hidden
        steps, n = x.shape
        size = mask.sum(0).astype(int)
        turned = np.stack([np.concatenate([col[:m][::-1], col[m:]]) for col, m in zip(x.T, size, strict=True)], 1)
        xs = np.stack([x, turned], 0)
        hs, cs = np.zeros((steps + 1, 2, n, h), np.float32), np.zeros((steps + 1, 2, n, h), np.float32)
        gates, tc = np.zeros((steps, 2, n, 4 * h), np.float32), np.zeros((steps, 2, n, h), np.float32)
        for t in range(steps):
            z = hs[t] @ w["U"] + np.stack([w["X"][0][xs[0, t]], w["X"][1][xs[1, t]]])
            z[..., : 3 * h] *= 0.5
            z /= 1 + np.abs(z)
            z[..., : 3 * h] = 0.5 + 0.5 * z[..., : 3 * h]
            gates[t] = z
            cs[t + 1] = z[..., h : 2 * h] * cs[t] + z[..., :h] * z[..., 3 * h :]
            tc[t] = cs[t + 1] / (1 + np.abs(cs[t + 1]))
            hs[t + 1] = z[..., 2 * h : 3 * h] * tc[t]
        back = np.arange(steps)[:, None]
        place = np.where(back < size[None, :], size[None, :] - 1 - back, back)  # where a time lies in the turned text
        cols = np.arange(n)[None, :]
        hb = hs[1:, 1][place, cols]
        e = hs[1:, 0] @ w["V"][0] + hb @ w["V"][1] + w["b"]
        # CRF: forward and backward sums in logarithms.
        a = w["A"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        lse = lambda q, axis: (mx := q.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(q - mx).sum(axis=axis))
        for t in range(1, steps):
            new = lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
            alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None], new, beta[t + 1])
        total = lse(alpha[-1], 1)
        p = np.exp(alpha + beta - total[:, None]) * mask[..., None]
        hot = np.eye(e.shape[-1], dtype=np.float32)[y] * mask[..., None]
        de = (p - hot) / n
        da = np.zeros_like(a)
        gold = (e * hot).sum((0, 2))
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :] - total[:, None, None]) * mask[t][:, None, None]
            da += pair.sum(0) / n
            np.subtract.at(da, (y[t - 1][mask[t]], y[t][mask[t]]), 1 / n)
            gold += np.where(mask[t], a[y[t - 1], y[t]], 0)
        loss = float((total - gold).mean())
        g = {"A": da, "b": de.sum((0, 1)), "V": np.stack([np.einsum("tnh,tnk->hk", hs[1:, 0], de), np.einsum("tnh,tnk->hk", hb, de)])}
        dh_all = np.zeros((steps, 2, n, h), np.float32)
        dh_all[:, 0] = de @ w["V"][0].T
        dh_all[place, 1, cols] = de @ w["V"][1].T
        gx, gu = np.zeros_like(w["X"]), np.zeros_like(w["U"])
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        ut = w["U"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            dh = dh + dh_all[t]
            z = gates[t]
            i, f, o, c = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
            dc = dc + dh * o * (1 - np.abs(tc[t])) ** 2
            gate = 0.25 * (1 - np.abs(2 * z[..., : 3 * h] - 1)) ** 2
            dz = np.concatenate([dc * c * gate[..., :h], dc * cs[t] * gate[..., h : 2 * h], dh * tc[t] * gate[..., 2 * h :], dc * i * (1 - np.abs(c)) ** 2], -1)
            gu += hs[t].transpose(0, 2, 1) @ dz
            for d in (0, 1):
                np.add.at(gx[d], xs[d, t], dz[d])
            dc = dc * f
            dh = dz @ ut
        g["X"], g["U"] = gx, gu
        return loss, g

    def update(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        for n, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            self.m[n] = 0.9 * self.m[n] + 0.1 * v
            self.v[n] = 0.999 * self.v[n] + 0.001 * v * v
            self.w[n] -= (rate * (self.m[n] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[n] / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)


def surroundings(data: str) -> list[str]:
    """Sentences of the ``SAMPLE`` documents and questions whose ids have the smallest hashes, each different sentence once."""
    import pyarrow.dataset as ds
    import xxhash

    rows = [(str(x["doc_id"]), x["text"] or "") for x in ds.dataset(f"{data}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    chats = ds.dataset(f"{data}/vscode_chats.parquet").to_table(columns=["requests"])["requests"].to_pylist()
    asked = [(q["requestId"], (q["message"] or {}).get("text") or "") for chat in chats for q in (chat or []) if q and q["requestId"]]
    found: dict[str, None] = {}
    for part in (rows, asked):
        for _, text in sorted(part, key=lambda x: (xxhash.xxh64_intdigest(x[0]), x[1]))[:SAMPLE]:
            for s in re.split(r"[\r\n]+| - |(?<=[.?!]) (?=[A-ZÀ-Ý¿])", text):
                if 0 < len(s.strip()) < 200:
                    found.setdefault(s.strip())
    return [*found, *code_lines(len(found))]


def code_lines(most: int) -> list[str]:
    """Lines of code and comments of the standard library without signs of mail, authors or house numbers: ``most`` with the smallest hashes."""
    import pathlib
    import sysconfig

    import xxhash

    lines = set()
    for path in sorted(pathlib.Path(sysconfig.get_path("stdlib")).glob("*.py")):
        lines.update(x.strip() for x in path.read_text(errors="replace").splitlines())
    kept = [x for x in lines if 12 < len(x) < 160 and not re.search(r"\w@\w|uthor|opyright|ontributed|ritten by|[A-Z][a-z]+ [A-Z]|\d{5}", x)]
    return sorted(kept, key=xxhash.xxh64_intdigest)[:most]


def _work(task: tuple) -> tuple:
    """A few steps of Adam from the given state on texts of the worker's own."""
    weights, first, second, steps, seed, rate, around = task
    trainer = Trainer(0)
    trainer.w, trainer.m, trainer.v, trainer.steps = weights, first, second, steps
    maker = Maker(seed, around)
    table = _table()
    made = sorted((maker.text() for _ in range(STEPS * BATCH_TEXTS)), key=lambda x: len(x[0]) + maker.r.random() * 24)
    groups = [made[k : k + BATCH_TEXTS] for k in range(0, len(made), BATCH_TEXTS)]
    maker.r.shuffle(groups)
    losses = []
    for part in groups:
        longest = max(1, max(len(s) for s, _ in part))
        x, y = np.zeros((longest, len(part)), np.int64), np.zeros((longest, len(part)), np.int64)
        mask = np.zeros((longest, len(part)), bool)
        for c, (s, t) in enumerate(part):
            x[: len(s), c], y[: len(s), c], mask[: len(s), c] = table[[ord(z) for z in s]], t, True
        loss, g = trainer.batch(x, y, mask)
        trainer.update(g, rate)
        losses.append(loss)
    return trainer.w, trainer.m, trainer.v, float(np.mean(losses))


_symbols: list[np.ndarray] = []


def _table() -> np.ndarray:
    from skeinlog.llm.pii import _symbol_table

    if not _symbols:
        _symbols.append(_symbol_table())
    return _symbols[0]


def train(data: str, out: str = MODEL, seed: int = 1, rounds: int = ROUNDS, start: str | None = None, rate: float = 0.012) -> None:
    """Trains (from the weights in ``start``, if given) and writes the weights; prints results on made texts of another seed.

    ``WORKERS`` processes each take ``STEPS`` steps on new texts; then their weights are averaged: one round.
    """
    around = surroundings(data)
    other = Maker(seed + 1_000_000, around)
    held = [other.text() for _ in range(1500)]
    own = Trainer(seed)
    if start:
        with np.load(start) as known:
            own.w = {n: v.astype(np.float32) for n, v in known.items()}
    w, m, v = own.w, own.m, own.v
    _table()
    began = time.time()
    with multiprocessing.get_context("fork").Pool(WORKERS) as pool:
        for k in range(rounds):
            now = rate * (0.5 * (1 + np.cos(np.pi * k / rounds)) + 0.02)
            done = pool.map(_work, [(w, m, v, k * STEPS, seed * 100_000 + k * WORKERS + i, now, around) for i in range(WORKERS)], chunksize=1)
            w, m, v = ({n: np.mean([d[j][n] for d in done], axis=0).astype(np.float32) for n in w} for j in range(3))
            if k % 10 == 9 or k == rounds - 1:
                tagger = Tagger({n: x.copy() for n, x in w.items()})
                right = wrong = missed = 0
                for (s, t), tags in zip(held, tagger.tag([s for s, _ in held]), strict=True):
                    want, got = items(s, np.array(t, np.int8)), items(s, tags)
                    right += len(set(want) & set(got))
                    wrong += len(set(got) - set(want))
                    missed += len(set(want) - set(got))
                print(f"round {k} loss {np.mean([d[3] for d in done]):.3f} held out: right {right} wrong {wrong} missed {missed} ({time.time() - began:.0f} s)", flush=True)
    np.savez(out, **{n: x.astype(np.float16) if n == "X" else x for n, x in w.items()})


if __name__ == "__main__":
    # The weights beside the model: 360 rounds, then 110, 90, 45, 160 and 90 more at lower rates.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    train(sys.argv[1])
    train(sys.argv[1], seed=2, rounds=110, start=MODEL, rate=0.005)
    train(sys.argv[1], seed=3, rounds=90, start=MODEL, rate=0.005)
    train(sys.argv[1], seed=4, rounds=45, start=MODEL, rate=0.004)
    train(sys.argv[1], seed=5, rounds=160, start=MODEL, rate=0.008)
    train(sys.argv[1], seed=6, rounds=90, start=MODEL, rate=0.006)
