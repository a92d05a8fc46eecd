"""Trains the classifier of ``defects``: ``python -m skeinlog.llm.defects_training DATA_DIR``.

Pairs of a bounded sample of ``vscode_chats`` (``SAMPLE``, unlabelled, those with the smallest hashes) are truncated,
copied, swapped and refused synthetically; refusals are put together by small grammars of how such sentences are
made in each language. Pairs that the first round finds defective are left out of the second. Profiles of languages
come from the ``lang`` column of a sample of ``documents`` and the texts below.
"""

from __future__ import annotations

import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np

from skeinlog.llm.defects import BITS, DEFECTS, DENSE, LANGUAGE_BITS, LANGUAGES, LATIN, MODEL, Model, simplified, triples, visible

#: Most pairs, and most documents, that training sees.
SAMPLE = 6000
ROUNDS = 8
#: Defects that n-grams may tell; copies and languages are told by the pair features alone, whatever the words.
BY_WORDS = np.array([d in ("empty", "truncated", "refusal") for d in DEFECTS], float)
#: Assumed share of each defect where thresholds are set; made rows hold far more.
PRIOR = 0.1

#: Grammars of refusals by language: opening, inability, deed, object, reason, close; fixed values.
REFUSALS = {
    "en": (
        ["I'm sorry, but ", "Sorry, ", "I'm afraid ", "Unfortunately, ", "I apologise, but ", "I regret that ", "With respect, ", "Thank you for asking, but ", "As an AI, ", "As a language model, ", "", "", "", "", "No, "],
        ["I can't ", "I cannot ", "I am unable to ", "I'm not able to ", "I won't ", "I will not ", "I must decline to ", "I have to decline to ", "I must respectfully decline to ", "I have to refuse to ", "I refuse to ", "I would rather not ", "I prefer not to ", "I'm not allowed to ", "I am not permitted to ", "I'm not in a position to ", "it isn't possible for me to ", "I don't feel comfortable enough to ", "it would be wrong for me to ", "I am going to have to pass and not ", "nobody can make me "],
        ["help with ", "assist with ", "help you with ", "answer ", "provide ", "discuss ", "share ", "do ", "carry out ", "support ", "comply with ", "fulfil ", "talk about ", "go into ", "respond to ", "continue with ", "take part in ", "give advice on ", "comment on ", "work on ", "deal with "],
        ["that", "this", "this request", "that request", "your request", "such a request", "requests like this", "what you ask for", "that information", "this topic", "this question", "this matter", "anything of this kind", "it", "this task", "that subject"],
        ["", "", "", "", " because it goes against my guidelines", " since it isn't allowed", " as this would not be appropriate", " for safety reasons", " due to the rules I follow", " because my policies forbid it", " as it may cause harm", " under any circumstances", " at all", " any further", " for reasons of policy"],
        [".", ".", ".", "", "!", ". Is there something else I can do?", ". Let me know if you need anything else.", ". Please ask me something different.", ". I hope you understand.", ". Thank you for your understanding.", ". You may want to talk to an expert."],
    ),
    "de": (
        ["Es tut mir leid, aber ", "Leider ", "Tut mir leid, ", "Entschuldige, ", "Bedaure, ", "Als KI ", "", "", "Nein, "],
        ["ich kann ", "ich darf ", "ich möchte ", "ich werde ", "ich muss es ablehnen, ", "es ist mir nicht erlaubt, ", "es ist mir nicht möglich, ", "ich bin nicht in der Lage, ", "ich weigere mich, "],
        ["dir dabei nicht ", "dabei nicht ", "dazu nichts ", "auf diese Frage nicht ", "über dieses Thema nicht ", "dieser Bitte nicht ", "diesen Wunsch nicht ", "diese Anfrage nicht ", "diesen Auftrag nicht "],
        ["helfen", "zu helfen", "sagen", "eingehen", "sprechen", "nachkommen", "erfüllen", "bearbeiten", "beantworten", "auszuführen", "zu bearbeiten", "weiterführen", "unterstützen"],
        ["", "", "", ", weil es gegen meine Vorgaben geht", ", da es nicht zulässig ist", ", denn die Regeln verbieten es", " aus Gründen der Sicherheit", ", weil das Schaden anrichten kann"],
        [".", ".", "", ". Kann ich sonst etwas tun?", ". Frag mich bitte etwas anderes.", ". Ich bitte um Verständnis."],
    ),
    "fr": (
        ["Je suis désolé, mais ", "Désolé, ", "Malheureusement, ", "Je regrette, mais ", "Navré, ", "En tant qu'IA, ", "", "", "Non, "],
        ["je ne peux pas ", "je ne suis pas en mesure de ", "je ne suis pas autorisé à ", "je dois refuser de ", "je refuse de ", "je ne souhaite pas ", "je ne vais pas ", "il m'est interdit de ", "il ne m'est pas possible de ", "je préfère ne pas "],
        ["vous aider avec ", "t'aider pour ", "répondre à ", "traiter ", "parler de ", "fournir ", "satisfaire ", "poursuivre ", "faire ", "donner suite à "],
        ["cette demande", "cela", "ce sujet", "cette question", "votre requête", "ce que vous demandez", "une telle demande", "cette tâche"],
        ["", "", "", " car c'est contraire à mes règles", " parce que ce n'est pas permis", " pour des raisons de sécurité", " puisque cela pourrait nuire"],
        [".", ".", "", ". Puis-je faire autre chose ?", ". Merci de votre compréhension.", ". Posez-moi plutôt une autre question."],
    ),
    "es": (
        ["Lo siento, pero ", "Lo lamento, ", "Desgraciadamente, ", "Por desgracia, ", "Disculpa, ", "Como IA, ", "", "", "No, "],
        ["no puedo ", "no me es posible ", "no tengo permitido ", "debo negarme a ", "me niego a ", "no quiero ", "no voy a ", "tengo prohibido ", "no estoy en condiciones de ", "prefiero no "],
        ["ayudarte con ", "ayudar con ", "responder a ", "atender ", "hablar de ", "dar ", "cumplir ", "continuar con ", "hacer ", "tratar "],
        ["esta solicitud", "eso", "este tema", "esa pregunta", "tu petición", "lo que pides", "algo así", "esta tarea"],
        ["", "", "", " porque va contra mis reglas", " ya que no está permitido", " por motivos de seguridad", " porque podría causar daño"],
        [".", ".", "", ". ¿Necesitas algo más?", ". Gracias por comprender.", ". Pregúntame otra cosa, por favor."],
    ),
}
#: Further makes of refusals by language, each a list of parts; fixed values.
INVERTED = {
    "en": [
        [["", "Sorry, ", "No, ", "Well, ", "Unfortunately "], ["my guidelines ", "my rules ", "my instructions ", "the policies I follow ", "company policy ", "safety rules "], ["don't allow ", "forbid ", "rule out ", "do not permit ", "prevent ", "prohibit "], ["this", "me to do that", "any work on {f}", "an answer here", "that kind of request", "going any further", "changes to {f}", "me from helping"], [".", "", ". What else can I do?"]],
        [["", "Sorry, ", "Apologies, but ", "I'm afraid "], ["this request ", "that ", "such work ", "the thing you want ", "answering that ", "this subject ", "touching {f} "], ["is outside what I may do", "lies beyond what I am allowed to handle", "is something I have to turn down", "is off the table for me", "is not for me to do", "is where I stop", "isn't something I will take on", "has to be left to somebody else", "is against the rules given to me"], [".", "", ", and that is final.", ", so I will stop here."]],
        [["", "No. ", "Sorry. "], ["I will leave that alone", "I'm stepping back from this", "I decline to go on", "I say no to this one", "I want no part in this", "you will get no help from me with that", "I have been instructed not to go there", "I stay away from {f}"], [".", "", ". Anything else?"]],
    ],
    "de": [
        [["", "Leider ", "Nein, ", "Tut mir leid, "], ["dabei ", "damit ", "hierbei ", "in dieser Sache ", "bei so etwas "], ["kann ich ", "darf ich ", "werde ich ", "möchte ich "], ["nicht helfen", "nicht weitermachen", "dir nicht zur Seite stehen", "nicht mitwirken", "keine Hilfe anbieten"], [".", "", ". Etwas anderes vielleicht?"]],
        [["", "Leider ", "Nein, "], ["das ", "diese Bitte ", "so einen Auftrag ", "dieses Anliegen "], ["muss ich zurückweisen", "kann ich nicht annehmen", "darf ich nicht übernehmen", "lehne ich ab", "werde ich nicht tun", "muss ich ablehnen", "kann ich dir nicht geben"], [".", ""]],
        [["", "Leider "], ["meine Regeln ", "die Vorgaben ", "meine Anweisungen "], ["lassen so etwas nicht zu", "verbieten mir das", "erlauben keine Antwort", "schließen diese Arbeit aus"], [".", ""]],
        [["", "Leider "], ["dazu ", "zu diesem Thema ", "darüber "], ["äußere ich mich nicht", "gebe ich keine Antwort", "kann ich nichts beitragen", "sage ich lieber nichts"], [".", ""]],
    ],
    "fr": [
        [["", "Désolé, ", "Non, "], ["mes règles ", "mes instructions ", "les consignes que je suis "], ["ne permettent pas cela", "m'empêchent d'aller plus loin", "interdisent ce genre de travail", "ne me laissent pas répondre"], [".", ""]],
        [["", "Désolé, ", "Malheureusement "], ["ceci ", "ce que vous voulez ", "ce genre de demande "], ["sort de mon rôle", "dépasse ce que j'ai le droit de faire", "ne m'est pas permis", "est à laisser à quelqu'un d'autre"], [".", "", ", je m'arrête là."]],
        [["", "Non, "], ["je m'abstiens", "je dois décliner", "je ne le ferai pas", "je ne veux pas m'en occuper", "je n'irai pas plus loin"], [".", "", ". Autre chose ?"]],
    ],
    "es": [
        [["", "Lo siento, ", "No, "], ["mis reglas ", "mis instrucciones ", "las normas que sigo "], ["no permiten esto", "me impiden seguir", "prohíben este tipo de trabajo", "no me dejan responder"], [".", ""]],
        [["", "Lo siento, ", "Por desgracia "], ["esto ", "lo que quieres ", "este tipo de petición "], ["queda fuera de mi papel", "supera lo que puedo hacer", "no me está permitido", "le toca a otra persona"], [".", "", ", así que lo dejo aquí."]],
        [["", "No, "], ["me abstengo", "debo declinar", "no lo haré", "no quiero ocuparme de eso", "no iré más lejos"], [".", "", ". ¿Otra cosa?"]],
    ],
}
#: Refusals without the first person; fixed values.
FLAT = {
    "en": ["This is not something I do.", "That is outside of what I may do.", "My rules rule this out.", "This request is declined.", "Policy prevents an answer here.", "There won't be an answer from me on this.", "That goes beyond my limits.", "Such content is off the table.", "This conversation has to end here.", "Not something I can support.", "No answer to that one.", "The guidelines I work under forbid that.", "You will have to look elsewhere for this.", "Request denied."],
    "de": ["Das gehört nicht zu dem, was ich tue.", "Diese Anfrage wird abgelehnt.", "Meine Regeln schließen das aus.", "Darauf gibt es von mir keine Antwort.", "So etwas ist mir untersagt.", "Das geht über meine Grenzen hinaus."],
    "fr": ["Ce n'est pas quelque chose que je fais.", "Cette demande est refusée.", "Mes consignes l'excluent.", "Il n'y aura pas de réponse de ma part.", "Cela dépasse mes limites."],
    "es": ["Eso no es algo que yo haga.", "Esta solicitud queda rechazada.", "Mis normas lo excluyen.", "No habrá respuesta de mi parte.", "Eso supera mis límites."],
}
#: Beginnings and sentences that sound like a refusal and are none; fixed values.
HARMLESS = [
    "Sorry for the wait. ", "I couldn't find the old branch, so I started from the tag. ", "I cannot reach the server at the moment, but the code tells enough. ", "Unfortunately the first attempt broke a test. ", "I can't tell from the trace alone, yet two causes are likely. ", "The server refuses connections on that port. ", "The validator declines empty input by design. ",
    "That is not allowed by the linter. ", "I was unable to run it here; by reading, this is the problem. ", "You can't do this in one step. ", "It is not possible to change the type in place. ", "Sadly, the docs are wrong on this point. ", "I won't touch the other files. ", "My apologies, the earlier version had a typo. ", "I'm not sure why it was written that way. ", "No, that is not needed. ",
    "Leider war der erste Versuch zu langsam. ", "Ich kann den Server gerade nicht erreichen, der Code reicht aber. ", "Das geht nicht in einem Schritt. ", "Malheureusement le premier essai était trop lent. ", "Je ne peux pas joindre le serveur, mais le code suffit. ", "Ce n'est pas possible en une étape. ", "Por desgracia el primer intento era lento. ", "No puedo abrir el servidor, pero basta el código. ", "No se puede en un solo paso. ",
]
#: Whole answers that are short and sound; fixed values.
SHORT = ["42", "Yes.", "No.", "yes", "no", "Done.", "None", "true", "0", "17 rows", "`make all`", "npm test", "About 3 seconds.", "Twice.", "It depends.", "Ja.", "Nein.", "Fertig.", "Oui.", "Non.", "C'est fait.", "Sí.", "Hecho.", "main", "src/app.py", "Version 2.4.1", "git status", "OK", "Both.", "Line 12.", "- a\n- b", "```\nls\n```"]
#: Dressings of a copied question, and of one that an answer follows; fixed values.
DRESSINGS = ["{q}", "{q}", "{q}", "'{q}'", '"{q}"', "({q})", "> {q}", ">> {q}", "*{q}*", "**{q}**", "_{q}_", "Q. {q}", "Question - {q}", "You wrote: {q}", "Prompt: {q}", "The question was: {q}", "{q} ...", "{q}\n", "`{q}`", "```\n{q}\n```", "{q}\n{q}", "{q} {q}", "Frage - {q}", "Du schreibst: {q}", "Vous écrivez : {q}", "Escribes: {q}", "«{q}»", "“{q}”", "## {q}", "- {q}", "1. {q}"]
LED = ["{q}\n\n{a}", "> {q}\n\n{a}", "You wrote: {q}\n\n{a}", "**{q}**\n{a}", "{q} - {a}"]
#: Announcements of something that does not follow; fixed values.
ANNOUNCED = ["\n\nIn detail:", "\n\nHere is how:\n1.", "\nThe code is:\n```", "\n\nIm Einzelnen:", "\n\nSo geht es:\n1.", "\n\nEn détail :", "\n\nEn detalle:", "\n-", "\n\nFirst,", " For example:", " because", " and then the", " which is why the", " und dann die", " parce que la", " porque el"]
#: Requests for a language; fixed values.
IN_LANGUAGE = {"de": ["In German.", "Antworte auf Deutsch.", "German only, thanks."], "fr": ["In French.", "En français, merci.", "Use French."], "es": ["In Spanish.", "Responde en español.", "Spanish, please."], "en": ["In English.", "Antworte auf Englisch.", "Réponds en anglais.", "Responde en inglés."]}
#: Sample sentences of languages of which the corpus holds none; fixed values.
SENTENCES = {
    "it": "Il programma legge tutto il file ogni volta che parte e per questo è molto lento. Non devi cancellare la cartella prima che il processo sia finito. Ho aggiunto una prova per le righe vuote e adesso funziona. Questa funzione viene chiamata due volte con lo stesso valore, quindi il risultato è sbagliato. Puoi cambiare le impostazioni nella pagina che si apre dopo. Come posso sapere quale versione è stata usata? Perché non trova il nome della colonna?",
    "pt": "O programa lê o arquivo inteiro sempre que começa e por isso é muito lento. Não apague a pasta antes que o processo tenha terminado. Adicionei um teste para as linhas vazias e agora funciona. Esta função é chamada duas vezes com o mesmo valor, então o resultado está errado. Você pode mudar as configurações na página que abre depois. Como posso saber qual versão foi usada? Por que ele não encontra o nome da coluna?",
    "nl": "Het programma leest elke keer het hele bestand en daarom is het erg langzaam. Verwijder de map niet voordat het proces klaar is. Ik heb een test voor lege regels toegevoegd en nu werkt het. Deze functie wordt twee keer met dezelfde waarde aangeroepen, dus het resultaat klopt niet. Je kunt de instellingen wijzigen op de pagina die daarna opent. Hoe weet ik welke versie gebruikt is? Waarom vindt hij de naam van de kolom niet?",
    "pl": "Program czyta cały plik za każdym razem i dlatego jest bardzo wolny. Nie usuwaj katalogu, zanim proces się nie skończy. Dodałem test dla pustych wierszy i teraz działa. Ta funkcja jest wywoływana dwa razy z tą samą wartością, więc wynik jest zły. Możesz zmienić ustawienia na stronie, która się potem otworzy. Skąd mam wiedzieć, której wersji użyto? Dlaczego nie znajduje nazwy kolumny?",
    "sv": "Programmet läser hela filen varje gång det startar och därför är det mycket långsamt. Ta inte bort mappen innan processen är klar. Jag har lagt till ett test för tomma rader och nu fungerar det. Den här funktionen anropas två gånger med samma värde, så resultatet blir fel. Du kan ändra inställningarna på sidan som öppnas sedan. Hur vet jag vilken version som användes? Varför hittar den inte kolumnens namn?",
    "tr": "Program her başladığında dosyanın tamamını okuyor ve bu yüzden çok yavaş. İşlem bitmeden klasörü silme. Boş satırlar için bir test ekledim ve şimdi çalışıyor. Bu işlev aynı değerle iki kez çağrılıyor, bu yüzden sonuç yanlış. Daha sonra açılan sayfada ayarları değiştirebilirsin. Hangi sürümün kullanıldığını nasıl bilebilirim? Sütunun adını neden bulamıyor?",
    "en": "The program reads the whole file each time it starts and that is why it is slow. Don't delete the folder before the process has finished. You can change the settings on the page that opens next. How do I know which version was used? Why can't it find the name of the column?",
    "de": "Das Programm liest bei jedem Start die ganze Datei und ist deshalb langsam. Lösche den Ordner nicht, bevor der Vorgang beendet ist. Du kannst die Einstellungen auf der Seite ändern, die danach erscheint. Woher weiß ich, welche Version benutzt wurde? Warum findet es den Namen der Spalte nicht?",
    "fr": "Le programme lit tout le fichier à chaque démarrage et c'est pour cela qu'il est lent. Ne supprimez pas le dossier avant que le processus soit terminé. Vous pouvez changer les réglages sur la page qui s'ouvre ensuite. Comment savoir quelle version a été utilisée ? Pourquoi ne trouve-t-il pas le nom de la colonne ?",
    "es": "El programa lee todo el archivo cada vez que empieza y por eso es lento. No borres la carpeta antes de que termine el proceso. Puedes cambiar los ajustes en la página que se abre después. ¿Cómo sé qué versión se ha usado? ¿Por qué no encuentra el nombre de la columna?",
}


def learn_languages(texts: list[tuple[str, str]]) -> np.ndarray:
    """Logarithms of the shares of letter triples of each Latin language, from ``(language, text)``."""
    count = np.full((len(LATIN), 1 << LANGUAGE_BITS), 0.02)
    for language, text in [*texts, *SENTENCES.items()]:
        if language in LATIN:
            _, gram = triples([simplified(text)])
            np.add.at(count[LATIN.index(language)], gram, 1.0)
    # Profiles of few and of many texts weigh alike: each counts as 5,000 triples.
    count = 0.05 + 5000 * count / count.sum(1, keepdims=True)
    return np.log(count / count.sum(1, keepdims=True))


def truncated(r: random.Random, answer: str) -> str | None:
    """The answer cut off where it is not finished; None where no such place is found."""
    for _ in range(8):
        form = r.random()
        at = r.randint(max(3, len(answer) // 4), len(answer) - 1) if len(answer) > 8 else 0
        if form < 0.25 and "```" in answer:
            first = answer.index("```")
            at = first + r.randint(3, max(4, len(answer) - first - 4))
        elif form < 0.45 and "\n" in answer:
            rows = answer.split("\n")
            k = r.randint(1, len(rows))
            marker = re.match(r"\s*(?:[-*•]|\d+[.)])", rows[k - 1])
            if marker:
                text = "\n".join([*rows[: k - 1], marker.group()])
                return text if text.strip() and text.strip() != marker.group().strip() else None
        elif form < 0.52:
            return answer.rstrip() + r.choice(ANNOUNCED)
        elif form < 0.7:
            spaces = [m.start() for m in re.finditer(" ", answer)]
            at = r.choice(spaces) if spaces else at
        text = answer[:at].rstrip()
        if len(text) < 3 or not visible(text):
            continue
        if text.count("```") % 2 == 0 and (text[-1] in ".!?。:)`" or answer[at : at + 1] == "\n" or answer[at:].strip(" .!?。") == ""):
            continue
        return text
    return None


def refused(r: random.Random, language: str) -> str:
    """A made refusal."""
    key = language if language in REFUSALS else "en"
    if r.random() < 0.2:
        text = r.choice(FLAT[key])
        return text if r.random() < 0.6 else r.choice(REFUSALS[key][0]) + text
    parts = REFUSALS[key] if r.random() < 0.55 else r.choice(INVERTED[key])
    text = "".join(r.choice(part) for part in parts).replace("{f}", r.choice(["src/a.py", "lib/b/c.go", "that file"]))
    return text[0].upper() + text[1:]


def copied(r: random.Random, question: str) -> str:
    """The question again, dressed."""
    q, form = question, r.random()
    if form < 0.1:
        q = q.upper()
    elif form < 0.2:
        q = q.lower()
    elif form < 0.3:
        q = re.sub(" ", "  ", q)
    elif form < 0.4:
        q = q.rstrip(".?!")
    return r.choice(DRESSINGS).format(q=q)


def synthesize(r: random.Random, pairs: list[tuple[str, str]], spoken: list[tuple[str, str]]) -> list[tuple[tuple[str, str], int, int]]:
    """Pairs, the number of their defect (-1: none) and of the pair they are made from; ``spoken`` has the languages of the pairs."""
    out: list[tuple[tuple[str, str], int, int]] = []
    by: dict[str, list[str]] = {}
    for (_, a), (_, k) in zip(pairs, spoken, strict=True):
        if len(a) > 30:  # shorter ones hardly tell their language
            by.setdefault(k, []).append(a)
    by = {k: v for k, v in by.items() if len(v) >= 0.001 * len(pairs)}
    for n, ((q, a), (asked, own)) in enumerate(zip(pairs, spoken, strict=True)):
        out.append(((q, a), -1, n))
        for _ in range(2):
            cut = truncated(r, a) if len(a) >= 40 else None
            if cut:
                out.append(((q, cut), 1, n))
        for _ in range(2):
            out.append(((q, refused(r, asked if r.random() < 0.85 else r.choice(list(REFUSALS)))), 2, n))
        if q.strip():
            out.append(((q, copied(r, q)), 3, n))
            if r.random() < 0.5:
                out.append(((q, r.choice(LED).format(q=q, a=a)), -1, n))
        others = [k for k in by if k != own]
        if others and asked == own and len(a) > 30:
            k = r.choice(others)
            foreign = r.choice(by[k])
            out.append(((q, foreign), 4, n))
            if k in IN_LANGUAGE:
                out.append(((f"{q} {r.choice(IN_LANGUAGE[k])}", foreign), -1, n))
            other = [x for x in IN_LANGUAGE if x not in (own, k)]
            out.append(((f"{q} {r.choice(IN_LANGUAGE[r.choice(other)])}", foreign), 4, n))
        if r.random() < 0.3:
            out.append(((q, r.choice(HARMLESS) + a), -1, n))
        for _ in range(r.choice([0, 0, 0, 1])):
            out.append(((q, r.choice(SHORT)), -1, n))
        if r.random() < 0.1:
            out.append(((q, r.choice(["", " ", "\n", "​", "   \n"])), 0, n))
    return out


def fit(model: Model, rows: list[tuple[tuple[str, str], int, int]], seed: int, rounds: int = ROUNDS, prior: float = 0.5) -> np.ndarray:
    """Logistic regression for each defect by Adagrad; thresholds from a held-out fifth of the pairs with all made of them, at a share of ``prior``. Gives F1 of each defect there."""
    rng = np.random.default_rng(seed)
    row, place, value, dense = model.features([q for (q, _), _, _ in rows], [a for (_, a), _, _ in rows])
    order = np.argsort(row, kind="stable")
    row, place, value = row[order], place[order], value[order]
    start = np.searchsorted(row, np.arange(len(rows) + 1))
    target = np.zeros((len(rows), len(DEFECTS)))
    for k, (_, d, _) in enumerate(rows):
        if d >= 0:
            target[k, d] = 1
    held = np.array([n for _, _, n in rows]) % 5 == 4
    used = np.flatnonzero(~held)
    places = 1 << BITS
    w, g2 = np.zeros((places + DENSE, len(DEFECTS))), np.full((places + DENSE, len(DEFECTS)), 1e-6)
    for round_ in range(rounds):
        rng.shuffle(used)
        for k in range(0, len(used), 256):
            part = used[k : k + 256]
            size = start[part + 1] - start[part]
            local = np.repeat(np.arange(len(part)), size)
            at = np.repeat(start[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            i, v = place[at], value[at]
            z = dense[part] @ w[places:]
            for d in range(len(DEFECTS)):
                z[:, d] += np.bincount(local, weights=w[i, d] * v, minlength=len(part))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) / len(part)
            seen, back = np.unique(i, return_inverse=True)
            g = np.stack([np.bincount(back, weights=v * e[local, d], minlength=len(seen)) for d in range(len(DEFECTS))], 1)
            rate = 0.35 / (1 + 0.15 * round_)
            g2[seen] += g * g
            w[seen] -= rate * g / np.sqrt(g2[seen]) * BY_WORDS
            g = dense[part].T @ e
            g2[places:] += g * g
            w[places:] -= rate * g / np.sqrt(g2[places:])
    model.weights = w
    rest = np.flatnonzero(held)
    z = model.score([rows[k][0][0] for k in rest], [rows[k][0][1] for k in rest])
    model.threshold, best_f1 = np.zeros(len(DEFECTS)), np.zeros(len(DEFECTS))
    for d in range(len(DEFECTS)):
        by = np.argsort(-z[:, d])
        hit = target[rest][by, d]
        weigh = max(1, hit.sum()) * (1 - prior) / prior / max(1, (1 - hit).sum())
        f1 = 2 * np.cumsum(hit) / (np.cumsum(hit) + weigh * np.cumsum(1 - hit) + max(1, hit.sum()))
        best = int(f1.argmax())
        below = z[by[best + 1], d] if best + 1 < len(by) else z[by[best], d]
        model.threshold[d], best_f1[d] = np.clip((z[by[best], d] + below) / 2, -1.0, 6.0), f1[best]
    return best_f1


def _last(answer: str) -> str:
    """The last line in simplified form, where it has at least three words; else the whole answer."""
    line = simplified(answer).strip().rsplit("\n", 1)[-1]
    return line if len(line.split()) > 2 else answer


def train(pairs: list[tuple[str, str]], texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from sampled pairs, most of which are sound, and texts with their language. Two rounds: the second without what the first flags as defective."""
    r = random.Random(seed)
    model = Model(learn_languages(texts))
    pairs = [(q or "", a or "") for q, a in pairs if visible(a or "")]
    often = Counter(simplified(a).strip() for _, a in pairs)
    ends = Counter(_last(a) for _, a in pairs)
    # An answer that recurs but for names and numbers counts five times at most.
    seen: Counter[str] = Counter()
    unique = []
    for q, a in pairs:
        seen[simplified(a)] += 1
        if seen[simplified(a)] <= 5:
            unique.append((q, a))
    pairs = unique

    def languages(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
        asked, said = (model.spoken(x, [simplified(t) for t in x]).argmax(1) for x in ([q for q, _ in rows], [a for _, a in rows]))
        return [(LANGUAGES[i], LANGUAGES[j]) for i, j in zip(asked, said, strict=True)]

    # Each third is judged by a model of the other two, which has not seen its answers and takes none as a whole.
    sound = np.ones(len(pairs), bool)
    model.whole = False
    third = np.array([zlib.crc32(simplified(a).encode("utf-8", "surrogatepass")) % 3 for _, a in pairs])
    for k in range(3):
        rest = [p for p, t in zip(pairs, third, strict=True) if t != k] or pairs
        fit(model, synthesize(r, rest, languages(rest)), seed, 4)
        mine = np.flatnonzero(third == k)
        if not len(mine):
            continue
        over = model.score([pairs[i][0] for i in mine], [pairs[i][1] for i in mine]) > model.threshold - 1.0
        # What is said again and again in the same words, or ends in the same words, is no cut text, however it ends.
        over[:, 1] &= [often[simplified(pairs[i][1]).strip()] < 3 and ends[_last(pairs[i][1])] < 3 for i in mine]
        sound[mine] = ~over[:, 1:].any(1)
    model.whole = True
    kept = [p for p, s in zip(pairs, sound, strict=True) if s] or pairs
    f1 = fit(model, synthesize(r, kept, languages(kept)), seed, prior=PRIOR)
    print("pairs", len(pairs), "sound", len(kept), "held-out F1", dict(zip(DEFECTS, f1.round(4), strict=True)), "thresholds", model.threshold.round(2), flush=True)
    return model


def samples(data: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The ``SAMPLE`` pairs and documents with the smallest hashes of their ids."""
    import pyarrow.dataset as ds
    import xxhash

    pairs: dict[str, tuple[str, str]] = {}
    for chat in ds.dataset(f"{data}/vscode_chats.parquet").to_table(columns=["requests"])["requests"].to_pylist():
        for q in chat or []:
            if q and q["requestId"]:
                said = [e["value"] if e["kind"] is None else (e["content"] or {}).get("value") if e["kind"] == "markdownContent" else None for e in (q["response"] or []) if e]
                pairs[q["requestId"]] = ((q["message"] or {}).get("text") or "", "".join(x for x in said if x))
    taken = sorted(pairs, key=lambda k: (xxhash.xxh64_intdigest(k), k))[:SAMPLE]
    rows = ds.dataset(f"{data}/documents.parquet").to_table(columns=["doc_id", "text", "lang"]).to_pylist()
    rows.sort(key=lambda x: (xxhash.xxh64_intdigest(str(x["doc_id"])), x["text"] or ""))
    return [pairs[k] for k in taken], [(x["lang"], x["text"]) for x in rows[:SAMPLE] if x["lang"] and x["text"]]


def main(data: str, out: str = MODEL) -> None:
    """Trains on the samples in ``data`` and writes the weights."""
    began = time.time()
    model = train(*samples(data))
    np.savez_compressed(out, languages=model.languages.astype(np.float16), weights=model.weights.astype(np.float16), threshold=model.threshold)
    print(f"{time.time() - began:.0f} s")


if __name__ == "__main__":
    main(*sys.argv[1:3])
