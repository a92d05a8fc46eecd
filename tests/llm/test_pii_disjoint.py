"""Accuracy on sentences and a lexicon that share nothing with the training lists; items are marked ``[[kind:item]]``."""

from __future__ import annotations

import re

from skeinlog.llm import pii, pii_training

MARKED = """
Would you please let [[name:Rajesh Krishnamurthy]] know that the nightly job is green again?
My name is [[name:Gwendolyn Hargreaves]] and I can't open the dashboard.
The change came from [[name:Oluwaseun Adebayo]], not from me.
Best wishes, [[name:Siobhan Gallagher]]
ping [[name:Thandiwe Nkosi]] before you merge
[[name:Takumi Hashimoto]] broke the login on Friday, see lib/auth/token.rb
I spoke with [[name:Mr. Featherstonehaugh]] yesterday about the refund.
Das Ticket stammt von [[name:Wilhelmine Oberhuber]].
Merci de transmettre ceci à [[name:Guillaume Desrochers]].
Habla con [[name:Ximena Villanueva]] sobre el informe.
[[name:Krishnamurthy, Rajesh]] has signed the form
The reviewer, [[name:Prof. Abernathy]], wants smaller commits.
drop a line to [[email:gwen.hargreaves@fernhollow.org]] when you are done
new subscriber: [[email:o.adebayo77@lagosmail.net]]
the bounce was for [[email:SIOBHAN@GALLAGHER.IE]]
write [[email:thandi [at] kwanele [dot] co.za]] instead
User [[email:takumi_h@hashimoto.jp]] and user [[email:ximena@villanueva.mx]] share a session
set the reply address to [[email:helpdesk+urgent@northwindtraders.com]]
please dial [[phone:(415) 867-5309]] after lunch
Our hotline is [[phone:+44 161 496 0823]], open until six
ring back on [[phone:+49 89 636 48018]]
Rappelez le [[phone:01 70 18 99 00]] demain matin
el teléfono es [[phone:+34 912 345 678]]
my cell: [[phone:212-736-5000]]
he left [[phone:+81 3 3224 5000]] on the form
The form says [[id_number:078-05-1120]] under social security.
NI number is [[id_number:JG 10 37 59 A]] for the new starter
su documento nacional: [[id_number:44556677L]]
Seine Steuernummer ist [[id_number:86 095 742 719]].
He showed [[id_number:passport no. GB4471920]] at the desk
applicant gave [[id_number:219-09-9999]] and signed
they live at [[address:1600 Pennsylvania Avenue, Washington 20500]]
Please post it to [[address:221B Baker Street, London]]
meet me at [[address:350 Fifth Avenue, New York, NY 10118]]
Sitz der Firma: [[address:Friedrichstraße 43, 10969 Berlin]]
livrer au [[address:55 rue du Faubourg Saint-Honoré, 75008 Paris]]
la tienda está en [[address:Calle de Serrano 61, 28006 Madrid]]
send the keys to [[address:742 Evergreen Terrace, Springfield]]
[[name:Eleanor Whitcombe]], [[address:17 Wimpole Mews, Cambridge CB2 1TN]], [[phone:01223 337 733]]
The customer ([[name:Bartholomew Quigley]], [[email:bquigley@thornburyfarm.co.uk]]) wants a copy
contact [[name:Nokuthula Dlamini]] on [[phone:+27 11 376 3400]] or [[email:ndlamini@ubuntucape.co.za]]
""".strip().splitlines()

PLAIN = """
The garbage collector pauses for 240 ms every 15 minutes.
Ubuntu 22.04.3 ships OpenSSL 3.0.2 and Python 3.10.12.
git@bitbucket.org:platform/billing.git refuses the key
Rollback to 7f3c9e2b41d0 and tag it v4.18.2
The Wishlist Drawer overlaps the Basket Icon on small screens.
Zookeeper elects a leader on port 2181.
10.244.18.9 answered in 31 ms
see RFC 7231 section 6.5.1 and issue #48213
the nightly ran from 2024-03-18 02:15:00 until 04:40
e2b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855
kubelet[2214]: pod web-6d4cf56db6-x7k2p restarted 14 times
Wie groß darf die Datei höchstens sein?
Le serveur répond 503 depuis ce matin.
La consulta tarda 48 segundos y devuelve 12000 filas.
const total = items.reduce((a, b) => a + b.price, 0);
ffmpeg -i input.mp4 -crf 23 -preset slow output.mp4
@Override public String toString() on line 118
The Onboarding Checklist is hidden behind a flag.
uuid 9c5b94b1-35ad-49bb-b118-8e8fc24abf80 was seen twice
yarn add lodash@4.17.21 left-pad@1.3.0
""".strip().splitlines()


def parsed(line):
    text, want, at = "", [], 0
    for m in re.finditer(r"\[\[(\w+):((?:[^\]]|\](?!\]))*)\]\]", line):
        text += line[at : m.start()]
        want.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + line[at:], want


def test_lists_share_nothing():
    lists = set(pii_training.GIVEN + pii_training.FAMILY)
    own = {w for line in MARKED for m in re.finditer(r"\[\[name:([^\]]*)\]\]", line) for w in re.findall(r"[^\W\d_]{3,}", m[1])}
    assert not own & lists
    assert not {parsed(x)[0] for x in MARKED + PLAIN} & set(pii_training.CARRIERS + pii_training.NOTHING)


def test_recall_and_precision_on_unseen_vocabulary():
    rows = [parsed(x) for x in MARKED] + [(x, []) for x in PLAIN]
    found = pii.find_items([t for t, _ in rows])
    wanted = hit = given = right = 0
    for (_, want), got in zip(rows, found, strict=True):
        over = lambda x, ys: any(x[2] == y[2] and x[0] < y[1] and y[0] < x[1] for y in ys)
        wanted, given = wanted + len(want), given + len(got)
        hit, right = hit + sum(over(x, got) for x in want), right + sum(over(x, want) for x in got)
    print(f"recall {hit / wanted:.3f} precision {right / given:.3f} of {wanted}")
    assert hit / wanted >= 0.9 and right / given >= 0.9
