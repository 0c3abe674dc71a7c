"""The small labelled table the sequence model is trained on.

A row is a list of (piece, kind) with kind null for ordinary text. The sentences below are the table, one a
line; a slot in angle brackets stands for a labelled item, one in braces for ordinary filling. Rows are
drawn with a fixed seed, so the table is the same everywhere. Names come from the lexicon, and a part
of them are hidden from it, so that the model learns to do without. The sentences are of everyday letters, lists and
logs; none is taken from a table that the model is applied to. ``HELD_OUT`` is written apart and never trained on.
"""

from __future__ import annotations

import random

Row = list[tuple[str, str | None]]
#: Common given names, for names the lexicon doesn't know.
OTHER_GIVEN = {
    "en": "Alice Peter Diana Frank Helen George Karen Philip Susan Walter Janet Ralph Emily Arthur Brenda Neil Carol Hugh".split(),
    "de": "Anna Jürgen Petra Stefan Renate Holger Jutta Markus Ursula Dieter Heike Rainer Käthe Björn".split(),
    "fr": "Julie Émile Camille Laurent Nathalie Gilles Hélène René Sophie Alain Margaux François Chloé Denis".split(),
    "es": "Ana Luis Carmen Javier Beatriz Ángel Marta Raúl Isabel José Sofía Íñigo Lucía Tomás".split(),
}
#: Titles, and particles before a family name.
TITLES = {
    "en": "Mr Mrs Ms Miss Dr Mr. Mrs. Ms. Dr. Prof. Sir".split(),
    "de": "Herr Frau Herrn Dr. Prof. Hr. Fr.".split(),
    "fr": "M. Mme Mlle Dr Monsieur Madame Maître".split(),
    "es": "Sr. Sra. Don Doña D. Dr. Dra. Señor Señora".split(),
}
PARTICLES = {"en": ["de", "St.", "van", "O'"], "de": ["von", "zu", "van der", "von der"], "fr": ["de", "Le", "du", "de la", "La", "d'"], "es": ["de", "de la", "del", "de los", "y"]}
#: Parts of invented names of places, projects and machines in ordinary text.
PLACE_HEAD = "Amber Birch Crane Delta Frost Grove Harrow Ivory Kelp Lunar Maple North Opal Pine River Stone Swift Timber Violet Winter".split()
PLACE_TAIL = "bank bay court dale desk field ford gap hall hub lab lane line park peak point pool port road room shore side station view ville works".split()
#: Words of ordinary sentences: qualities, things, doings and circumstances.
SPEECH = {
    "en": (
        "the old|a new|our second|the broken|every small|that yellow|the empty|some other|the weekly|no useful".split("|"),
        "garden|engine|report|letter|bridge|window|parser|server room|meeting|harvest|library|invoice|ticket queue|backup|river|table of contents|query plan|coffee machine".split("|"),
        "needs|shows|moved|lost|opens|covers|slows down|replaces|never reaches|paints|counts|belongs to|stands beside|depends on".split("|"),
        "after lunch|in the spring|without asking|on Tuesday|for three weeks|at night|by mistake|before the rain|twice a year|as usual|near the end|because nobody looked".split("|"),
    ),
    "de": (
        "der alte|ein neuer|unser zweiter|der kaputte|jeder kleine|der leere|mancher".split("|"),
        "Garten|Bericht|Brief|Motor|Schrank|Weg|Antrag|Server|Kalender|Fahrplan|Speicher|Entwurf".split("|"),
        "braucht|zeigt|verlor|öffnet|bremst|ersetzt|erreicht nie|zählt|steht neben|hängt ab von".split("|"),
        "nach dem Essen|im Frühling|ohne Absprache|am Dienstag|seit drei Wochen|in der Nacht|aus Versehen|vor dem Regen|wie immer".split("|"),
    ),
    "fr": (
        "le vieux|un nouveau|notre second|le petit|chaque|l'autre|ce long".split("|"),
        "jardin|rapport|moteur|courrier|pont|serveur|calendrier|tableau|plan|dossier|marché|registre".split("|"),
        "demande|montre|a perdu|ouvre|ralentit|remplace|n'atteint jamais|compte|dépend de|précède".split("|"),
        "après le repas|au printemps|sans demander|mardi|depuis trois semaines|la nuit|par hasard|avant la pluie|comme toujours".split("|"),
    ),
    "es": (
        "el viejo|un nuevo|nuestro segundo|el pequeño|cada|el otro|este largo".split("|"),
        "jardín|informe|motor|correo|puente|servidor|calendario|cuadro|plano|expediente|mercado|registro".split("|"),
        "necesita|muestra|perdió|abre|frena|sustituye|nunca alcanza|cuenta|depende de|precede a".split("|"),
        "después de comer|en primavera|sin preguntar|el martes|desde hace tres semanas|de noche|sin querer|antes de la lluvia|como siempre".split("|"),
    ),
}
#: Syllables and endings of made-up nouns, words that tie a thing to its place, articles, counted things, openings and conjunctions.
SYLLABLES = "ba den fol gar hin kel lo mar nis or pel qua rin sto tar ul ver wen".split()
ENDINGS = {"en": ["", "er", "ing", "tion", "ment"], "de": ["", "e", "ung", "heit", "er", "schaft"], "fr": ["", "e", "age", "tion", "eur"], "es": ["o", "a", "ción", "dor", "dad"]}
OF = {"en": "of", "de": "von", "fr": "de", "es": "de"}
ARTICLES = {"en": ["the", "an", "one", "the"], "de": ["der", "das", "die", "dem", "den"], "fr": ["le", "la", "l'autre", "un"], "es": ["el", "la", "un", "su"]}
COUNTED = {"en": "rows pages lines boxes chairs miles entries letters days".split(), "de": "Zeilen Seiten Stühle Kisten Einträge Tage Briefe".split(), "fr": "lignes pages chaises jours lettres boîtes".split(), "es": "líneas páginas sillas días cartas cajas".split()}
OPEN = {"en": "In|Near|From|Nothing in|Only|See|Behind|Perhaps|Why does|Half of|If|If|When|When|Since|Although|Before|Until|Whether|Where|Then|That|Once|Does|Is|But|Today".split("|"), "de": "In|Bei|Aus|Nur|Hinter|Vielleicht|Warum|Es fehlt|Siehe|Ohne|Wenn|Als|Seit|Bevor|Ob|Weil|Heute|Dann".split("|"), "fr": "Dans|Près de|Il reste|Seul|Derrière|Pourquoi|Voir|Sans|Si|Quand|Lorsque|Avant|Depuis|Puis|Peut-être".split("|"), "es": "En|Cerca de|Queda|Solo|Tras|Por qué|Véase|Sin|Sobra|Si|Cuando|Antes de|Desde|Hoy|Luego|Tal vez".split("|")}
JOIN = {"en": "and|but|while|because|although|so".split("|"), "de": "und|aber|weil|obwohl|doch|dass".split("|"), "fr": "et|mais|car|quand|alors que|bien que".split("|"), "es": "y|pero|porque|aunque|cuando|mientras".split("|")}
NAMED = {
    "en": """{W} {W} <NAME> {ADV}.
{W} <NAME> {W} {W}
{S} {W} <NAME>.
{W}: <NAME>
Checked and released by <NAME>
Yours sincerely, <NAME>
Dear <NAME>, {S}
Hello <NAME>, {S}
{S} Kind regards, <NAME>
<NAME> called about {P}
<NAME> will chair the session on {P}.
The chair thanked <NAME> and <NAME> for the work on {P}.
I spoke to <NAME> {ADV}
Please forward this to <NAME> {ADV}.
{S} That was the idea of <NAME>, {ADV}.
Report by <NAME>, {P}
Talk with <NAME> — {P} — {D2}.{D2}.
Conversation: <NAME>, <NAME>, {P}
attn <NAME> re {P}
author=<NAME>;site={P}
by=<NAME> {p}={N}
@author: <NAME>
@from: <NAME>
- <NAME>
- <NAME> ({P})
From: <NAME>
Written by <NAME>.
In the words of <NAME>, {S}
As <NAME> put it, {S}
Question for <NAME> on {P}: {S}
Ask for <NAME> at the desk in {P}.
We visited <NAME> to see {P}.
the room of <NAME> is in {P}
<NAME>
<NAME> | {P} | {N}
<NAME>; {P}
<NAME> | <PHONE>
<NAME>; <PHONE>
<NAME> <<PHONE>>
<NAME> (<PHONE>)
<NAME>, <PHONE>
<NAME>
<PHONE>
<NAME> | <MAIL>
<NAME>; <MAIL>
<NAME> <<MAIL>>
<NAME>, <MAIL>
<NAME> | <ADDR>
<NAME>; <ADDR>
<NAME> <<ADDR>>
<NAME>, <ADDR>""",
    "de": """{W} {W} <NAME> {ADV}.
{W} <NAME> {W} {W}
{S} {W} <NAME>.
{W}: <NAME>
Geprüft von <NAME>
Freundliche Grüße, <NAME>
Liebe <NAME>, {S}
Sehr geehrte <NAME>, {S}
<NAME> rief wegen {P} an.
Bericht von <NAME> über {P}
{S} Das war ein Vorschlag von <NAME>.
Besprechung mit <NAME>, {P}
Wie <NAME> sagt: {S}
Nach Auskunft von <NAME>: {S}
Bitte an <NAME> weiterleiten, {ADV}.
Ich traf <NAME> in {P}.
@author: <NAME>
Verfasst von <NAME>
- <NAME>
<NAME>
<NAME> | <PHONE>
<NAME>; <PHONE>
<NAME> <<PHONE>>
<NAME> | <MAIL>
<NAME>; <MAIL>
<NAME> <<MAIL>>
<NAME>, <ADDR>
<NAME> | <ADDR>
<NAME>; <ADDR>
<NAME> <<ADDR>>""",
    "fr": """{W} {W} <NAME> {ADV}.
{W} <NAME> {W} {W}
{S} {W} <NAME>.
{W}: <NAME>
Vérifié par <NAME>
Bien à vous, <NAME>
Chère <NAME>, {S}
Bonjour <NAME>, {S}
<NAME> a téléphoné au sujet de {P}.
Compte rendu de <NAME> sur {P}
D'après <NAME>, {S}
Comme dit <NAME> : {S}
Échange avec <NAME>, {P}
Merci de transmettre à <NAME> {ADV}.
Question pour <NAME> : {S}
@author: <NAME>
Rédigé par <NAME>
Auteur : <NAME>
- <NAME>
<NAME>
<NAME> | <PHONE>
<NAME>; <PHONE>
<NAME> <<PHONE>>
<NAME> | <MAIL>
<NAME>; <MAIL>
<NAME> <<MAIL>>
<NAME> | <ADDR>
<NAME>; <ADDR>
<NAME> <<ADDR>>""",
    "es": """{W} {W} <NAME> {ADV}.
{W} <NAME> {W} {W}
{S} {W} <NAME>.
{W}: <NAME>
Revisado por <NAME>
Saludos, <NAME>
Querida <NAME>, {S}
Hola <NAME>, {S}
<NAME> llamó por {P}.
Resumen de <NAME> sobre {P}
En opinión de <NAME>, {S}
Como dice <NAME>: {S}
Charla con <NAME>, {P}
Reenviar a <NAME> {ADV}, por favor.
Duda para <NAME>: {S}
@author: <NAME>
Escrito por <NAME>
Autora: <NAME>
- <NAME>
<NAME>
<NAME> | <PHONE>
<NAME>; <PHONE>
<NAME> <<PHONE>>
<NAME> | <MAIL>
<NAME>; <MAIL>
<NAME> <<MAIL>>
<NAME> | <ADDR>
<NAME>; <ADDR>
<NAME> <<ADDR>>""",
}
CONTACT = {
    "en": """SSN <ID>
national id <ID>
national id: <ID>
NI no. <ID>
taxpayer no. <ID>
social security number <ID>
the page shows SSN <ID> {ADV}
goes to <ADDR>
moved to <ADDR>
{W} {W} <PHONE> {ADV}.
{W} <PHONE> {W} {W}
{S} {W} {W} <PHONE>
{W}: <PHONE>
{W} {W} <MAIL> {ADV}.
{W} <MAIL> {W} {W}
{S} {W} {W} <MAIL>
{W}: <MAIL>
{W} {W} <ID> {ADV}.
{W} <ID> {W} {W}
{S} {W} {W} <ID>
{W}: <ID>
{W} {W} <ADDR> {ADV}.
{W} <ADDR> {W} {W}
{S} {W} {W} <ADDR>
{W}: <ADDR>
Telephone <PHONE>
T: <PHONE>
cell <PHONE>
Ring <PHONE> {ADV}
You get me on <PHONE> {ADV}.
Send a text to <PHONE> if {S}
Office line: <PHONE>, {P}
@reach: <PHONE>
<PHONE>
{S} Our number: <PHONE>
E-mail: <MAIL>
Reply to <MAIL> {ADV}.
Mail from <MAIL>, {S}
A copy went to <MAIL> {ADV}.
@mail: <MAIL>
"from": "<MAIL>"
address: mailto:<MAIL>
<MAIL>
{S} Answers go to <<MAIL>> please.
Undelivered: <MAIL> ({P})
Social security no. <ID>
social security number: <ID> in the file of {P}
SSN: <ID>
National insurance <ID>
NI number: <ID>
national identity number <ID>, {P}
tax number <ID>
identity card <ID>
passport number <ID>
Her SSN is <ID>, {S}
The copy with NI no. <ID> was shredded {ADV}.
@id-card: <ID>
{S} His id: <ID>
Please black out <ID> on page {N}.
Post it to <ADDR>
Home: <ADDR>
They live at <ADDR> {ADV}.
The parcel for <ADDR> is in {P}.
See you at <ADDR>, {ADV}.
@home: <ADDR>
<ADDR>
{S} The shop at <ADDR> has moved.""",
    "de": """Ausweis-Nr. <ID>
Steueridentifikationsnummer <ID>
Sozialversicherungsnummer <ID>
Steuer-Nr.: <ID> {ADV}
zieht nach <ADDR>
in der <ADDR>
{W} {W} <PHONE> {ADV}.
{W} <PHONE> {W} {W}
{S} {W} {W} <PHONE>
{W}: <PHONE>
{W} {W} <MAIL> {ADV}.
{W} <MAIL> {W} {W}
{S} {W} {W} <MAIL>
{W}: <MAIL>
{W} {W} <ID> {ADV}.
{W} <ID> {W} {W}
{S} {W} {W} <ID>
{W}: <ID>
{W} {W} <ADDR> {ADV}.
{W} <ADDR> {W} {W}
{S} {W} {W} <ADDR>
{W}: <ADDR>
Telefon <PHONE>
Tel <PHONE>
Handy: <PHONE>
Erreichbar unter <PHONE>, {ADV}
Bitte <PHONE> wählen.
@reach: <PHONE>
<PHONE>
E-Mail: <MAIL>
Antwort bitte nach <MAIL>
Eine Kopie ging an <MAIL> {ADV}.
mailto:<MAIL>
<MAIL>
Personalausweis <ID>
Ausweisnummer: <ID>
Steuernummer <ID>
Steuer-ID: <ID>
Sozialversicherung <ID>, {P}
Rentenversicherungsnummer: <ID>
{S} Ausweis: <ID>
Bitte <ID> auf Seite {N} streichen.
Anschrift: <ADDR>
Wohnhaft <ADDR>
Lieferung nach <ADDR>
Treffpunkt <ADDR>, {ADV}
<ADDR>
{S} Das Haus <ADDR> steht leer.""",
    "fr": """NIR <ID>
INSEE <ID>
n° de sécurité sociale <ID>
sécu : <ID>
au <ADDR>
déménage au <ADDR>
{W} {W} <PHONE> {ADV}.
{W} <PHONE> {W} {W}
{S} {W} {W} <PHONE>
{W}: <PHONE>
{W} {W} <MAIL> {ADV}.
{W} <MAIL> {W} {W}
{S} {W} {W} <MAIL>
{W}: <MAIL>
{W} {W} <ID> {ADV}.
{W} <ID> {W} {W}
{S} {W} {W} <ID>
{W}: <ID>
{W} {W} <ADDR> {ADV}.
{W} <ADDR> {W} {W}
{S} {W} {W} <ADDR>
{W}: <ADDR>
Téléphone : <PHONE>
Tél : <PHONE>
Mobile <PHONE>
Appelez le <PHONE> {ADV}
@reach: <PHONE>
<PHONE>
Courriel : <MAIL>
Répondre à <MAIL> {ADV}.
Copie envoyée à <MAIL>
mailto:<MAIL>
<MAIL>
Sécurité sociale <ID>
Numéro de sécurité sociale : <ID>
n° INSEE <ID>
NIR : <ID>, {P}
carte d'identité <ID>
{S} Son numéro : <ID>
Biffer <ID> page {N}.
Adresse postale : <ADDR>
Il habite <ADDR>
Envoi au <ADDR>
On se voit <ADDR>, {ADV}
<ADDR>
{S} La maison du <ADDR> est vide.""",
    "es": """documento de identidad <ID>
NIF <ID>
identidad: <ID>
a <ADDR>
se muda a <ADDR>
{W} {W} <PHONE> {ADV}.
{W} <PHONE> {W} {W}
{S} {W} {W} <PHONE>
{W}: <PHONE>
{W} {W} <MAIL> {ADV}.
{W} <MAIL> {W} {W}
{S} {W} {W} <MAIL>
{W}: <MAIL>
{W} {W} <ID> {ADV}.
{W} <ID> {W} {W}
{S} {W} {W} <ID>
{W}: <ID>
{W} {W} <ADDR> {ADV}.
{W} <ADDR> {W} {W}
{S} {W} {W} <ADDR>
{W}: <ADDR>
Teléfono: <PHONE>
Tel. <PHONE>
Celular <PHONE>
Marca el <PHONE> {ADV}
@reach: <PHONE>
<PHONE>
Correo: <MAIL>
Responder a <MAIL> {ADV}.
Copia enviada a <MAIL>
mailto:<MAIL>
<MAIL>
DNI <ID>
NIF: <ID>
DNI: <ID>, {P}
NIE <ID>
documento nacional de identidad <ID>
{S} Su número: <ID>
Tachar <ID> en la página {N}.
Domicilio: <ADDR>
Vive en <ADDR>
Envío a <ADDR>
Nos vemos en <ADDR>, {ADV}
<ADDR>
{S} La casa de <ADDR> está vacía.""",
}
PLAIN = {
    "en": """See {P}, figure {N}.
See {P} for more. {S}
See {P}, line {N}. {S}
Ask {P} {ADV}
Visit {P}, {S}
Leave {P} {ADV}.
{S} Compare {P}, {N}
Note {P} {N}
- [ ] {P}, {S}
* {P}, {S}
{N}. {P}, {S}
{P}, {S}
{N} {P} Lane-style drawings
{N} {P} Street cases and {N} {W}
checksum {D15}
{LABEL} {IDLIKE} is in {P}.
{LABEL} {PHONELIKE} stands in {P}.
See {P}, {N}.
{N}. {P}
{S} See {P}, {S}
{LABEL} {IDLIKE} {W} {W} {P}.
{W} {LABEL} {IDLIKE} {ADV}
{S} {LABEL} {IDLIKE} {S}
{LABEL} {IDLIKE}, {S}
{LABEL} {PHONELIKE}
{LABEL} {PHONELIKE} {W} {W} {P}.
{LABEL} {PHONELIKE} {ADV}
{LABEL}: {IDLIKE}
{W} v{D1}.{D2}.{D2}.{D2} {W} {P}
v{D1}.{D2}.{D2}
{W} {D2}.{D6}, -{D1}.{D6} {W}
{D1}.{D3}.{D3} {W}, {N} {W}
{DATE}
@{p}: {DATE}
@seen {DATE} in {P}
{P};{DATE};{N}
| {P} | {DATE} | {N} |
{P}	{DATE}	{N}
{DATE} {P} {S}
{N} {P} Street posters
{S} {N} {P} Road maps
about {N} {P} Lane-side stories
some {N} {P} Avenue fans
Use @2x.png here
Open @3x.jpg in {P}
{W} @{p}.{p} {W}
{p}@{D1}.{D2}
@{p}/{p}@{D1}.{D2}.{D1}
{W} {p}@{D1}.{D2} {W}
Take @{p} and @all {ADV}
at {N} @ {P}
{p}@{HEX8} {ADV}
{N},{P},0.{D3}
{HEX8}
@{p}: {P}
@{p}: {S}
{S}
{S}
{S} {S}
{S} {P} is quite near.
{P} was late, {S}
{N} of {N} rows
See chapter {N} and page {N} of {P}.
It ran for {N} seconds; {P} for {N}.
- {P}, {S}
{D1}) {P}, {S}
{P} {N}
{P}
{p} {p}{D1} {N}
I saw {G} {ADV}.
{G} is away this week.
{G} and {G} know {P}
The {F} file is missing.
Will the queue hold, and can we mark it as done?
Rose coloured walls and an iris in the garden of {P}
We grant access on good faith {ADV}.
{LABEL} {IDLIKE}
{LABEL} {IDLIKE} in {P}
{LABEL} {IDLIKE}, see {P}
{LABEL} {IDLIKE} ({P}) {ADV}
{LABEL} {PHONELIKE}
{LABEL} {PHONELIKE} in {P}
issue {D3}-{D4} of {P} was closed
ISBN 97{D1}-{D1}-{D4}-{D4}-{D1}
Checksum {D15} of {P}
md5 {HEX8}{HEX8}{HEX8}{HEX8}
Score 0.{D6} at 20{D2}-{D2}-{D2} {D2}:{D2}:{D2}
20{D2}-{D2}-{D2}T{D2}:{D2}:{D2}Z {P} {D5}
position {D2}.{D6}, -{D1}.{D6} of {P}
Release {D1}.{D2}.{D2}.{D3} of {P}
build {D4}.{D2}.{D3}-{D4} passed
{D1}.{D3}.{D3} rows and {N} {P} Street signs
The {P} Road plan has {N} more steps.
Paragraph {N} Lane {D1} of the map
port {D4}, pid {D6}, uid {D5}
uuid {HEX8}-{D4}-{D4}-{D4}-{D12}
Lunch @ {N} past noon in {P}.
git clone git@{p}:letters.git
Pin {p}@{D1}.{N}.{D1} again.
npm add @{p}/{p}@{D1}.{D2}
from {P} import {p}@{HEX8}
icon @2x.png, hello @here and @{p}
contact {p}@ or `{p}.example`
@decision: {S}
@due: 20{D2}-{D2}-{D2}
@project: {P}
@topic: {p}-{p}
"{p}": "{D3}-{D4}-{D4}", "rev": "{HEX8}"
{p} = {p}[{N}]
[[{p}/{p}.md]]
| {P} | {N} | 0.{D3} | 20{D2}-{D2}-{D2} |
{P}	{N}	0.{D3}	{P}
{P};{N};0.{D3};{P}
{P},0.{D3},{N}
│ {N} │ {P} │ {P} │
{"ok": true, "count": {N}, "rows": [{N}, {N}, {N}]}
invoice {D6} of 20{D2}-{D2}-{D2}
Figure {D1}, table {D1}
room {N}, floor {D1}
{D2}:{D2} to {D2}:{D2}
order {D8} was sent
{B64}/{B64}+{B64}
{N},{N},{N},{N},{N},{N}
{D2} {D2} {D2} {D2} {D2} {D2}
at {p}.{p}({p}.go:{N})
if {p} == {N}: return {p}({N})
def {p}({p}, {p}):
// {P} {D1}.{D1}
```
fn {p}({p}) { {N} }
- [x] {S}
user: {S}
assistant: {S}""",
    "de": """Siehe {P}, {N}.
Bleibt {P} {W}.
{W} {P}, {S}
Fehlt {P}? {S}
{N}. {P}
{N}. {S}
- [x] {P}, {S}
* {S}
| {S} | {P} | {N} |
{S}; {P}; {N}
{P}, {S}
@{p}: {S}
{LABEL} {IDLIKE} {W} {W} {P}.
{W} {LABEL} {IDLIKE} {ADV}
{S} {LABEL} {IDLIKE} {S}
{LABEL} {IDLIKE}, {S}
{LABEL} {PHONELIKE}
{LABEL} {PHONELIKE} {W} {W} {P}.
{LABEL} {PHONELIKE} {ADV}
{LABEL}: {IDLIKE}
{W} v{D1}.{D2}.{D2}.{D2} {W} {P}
v{D1}.{D2}.{D2}
{W} {D2}.{D6}, -{D1}.{D6} {W}
{D1}.{D3}.{D3} {W}, {N} {W}
@{p}: {DATE}
{P};{DATE}
| {P} | {DATE} |
{S} {DATE}
{S} {S}
{S} {S} {S}
@{p}: {S}
{S}
{S}
{S} {P} liegt nahe.
Seite {N} fehlt.
{P} {N}
{P}
- {P}, {S}
Ich sah {G} {ADV}.
{G} kommt später.
Es dauerte {N} Sekunden, {P} nur {N}.
{LABEL} {IDLIKE}
{LABEL} {IDLIKE} {ADV}
{LABEL} {PHONELIKE} in {P}
{P};{N};{P}
{P}	{N}	{P}
| {P} | {N} |
Bestellung {IDLIKE}
Die Liste hat {N} Zeilen aus {P}.""",
    "fr": """Reste {P} {W}.
Voir {P}, {N}.
Manque encore {P}, {S}
{W} {P}, {S}
{N}. {P}
{N}. {S}
- [x] {P}, {S}
* {S}
| {S} | {P} | {N} |
{S}; {P}; {N}
{P}, {S}
@{p}: {S}
{LABEL} {IDLIKE} {W} {W} {P}.
{W} {LABEL} {IDLIKE} {ADV}
{S} {LABEL} {IDLIKE} {S}
{LABEL} {IDLIKE}, {S}
{LABEL} {PHONELIKE}
{LABEL} {PHONELIKE} {W} {W} {P}.
{LABEL} {PHONELIKE} {ADV}
{LABEL}: {IDLIKE}
{W} v{D1}.{D2}.{D2}.{D2} {W} {P}
v{D1}.{D2}.{D2}
{W} {D2}.{D6}, -{D1}.{D6} {W}
{D1}.{D3}.{D3} {W}, {N} {W}
@{p}: {DATE}
{P};{DATE}
| {P} | {DATE} |
{S} {DATE}
{S} {S}
{S} {S} {S}
@{p}: {S}
{S}
{S}
{S} {P} est tout près.
La page {N} manque.
{P} {N}
{P}
- {P}, {S}
J'ai vu {G} {ADV}.
{G} arrive plus tard.
Cela a pris {N} secondes ; {P}, {N}.
{LABEL} {IDLIKE}
{LABEL} {IDLIKE} {ADV}
{LABEL} {PHONELIKE} de {P}
{P};{N};{P}
{P}	{N}	{P}
| {P} | {N} |
Commande {IDLIKE}
La liste a {N} lignes de {P}.""",
    "es": """Queda {P} {W}.
Sobra {P} {ADV}.
Véase {P}, {N}.
Sube {P} {W}
{W} {P}, {S}
{N}. {P}
{N}. {S}
- [x] {P}, {S}
* {S}
| {S} | {P} | {N} |
{S}; {P}; {N}
{P}, {S}
@{p}: {S}
{LABEL} {IDLIKE} {W} {W} {P}.
{W} {LABEL} {IDLIKE} {ADV}
{S} {LABEL} {IDLIKE} {S}
{LABEL} {IDLIKE}, {S}
{LABEL} {PHONELIKE}
{LABEL} {PHONELIKE} {W} {W} {P}.
{LABEL} {PHONELIKE} {ADV}
{LABEL}: {IDLIKE}
{W} v{D1}.{D2}.{D2}.{D2} {W} {P}
v{D1}.{D2}.{D2}
{W} {D2}.{D6}, -{D1}.{D6} {W}
{D1}.{D3}.{D3} {W}, {N} {W}
@{p}: {DATE}
{P};{DATE}
| {P} | {DATE} |
{S} {DATE}
{S} {S}
{S} {S} {S}
@{p}: {S}
{S}
{S}
{S} {P} queda cerca.
Falta la página {N}.
{P} {N}
{P}
- {P}, {S}
Vi a {G} {ADV}.
{G} viene luego.
Duró {N} segundos; {P}, {N}.
{LABEL} {IDLIKE}
{LABEL} {IDLIKE} {ADV}
{LABEL} {PHONELIKE} de {P}
{P};{N};{P}
{P}	{N}	{P}
| {P} | {N} |
Encargo {IDLIKE}
La lista tiene {N} filas de {P}.""",
}
#: Another hand's sentences, to measure with: other lead-ins, other orders, none of them in the tables above.
HELD_OUT = {
    "en": ["Minutes approved: <NAME>", "My neighbour <NAME> lent us {P}.", "<NAME> isn't in today, try <PHONE>.", "Hotline <PHONE> ({ADV})", "Complaints: <MAIL>", "cc: <MAIL>, <MAIL>", "insured under SSN <ID>", "Flat for rent, <ADDR>, {S}", "Parcel {IDLIKE} left {P}.", "{LABEL} {PHONELIKE} is full", "{S} {S}", "{P} and {P} meet {ADV}."],
    "de": ["Protokoll: <NAME>", "Meine Nachbarin <NAME> war in {P}.", "Notruf <PHONE>", "Beschwerden an <MAIL>", "versichert unter Sozialversicherungsnummer <ID>", "Zu vermieten: <ADDR>", "Paket {IDLIKE} ging nach {P}.", "{S} {S}"],
    "fr": ["Procès-verbal : <NAME>", "Ma voisine <NAME> connaît {P}.", "Urgences : <PHONE>", "Réclamations : <MAIL>", "assuré sous le numéro de sécurité sociale <ID>", "À louer : <ADDR>", "Colis {IDLIKE} pour {P}.", "{S} {S}"],
    "es": ["Acta: <NAME>", "Mi vecina <NAME> conoce {P}.", "Urgencias: <PHONE>", "Quejas a <MAIL>", "con DNI <ID>", "Se alquila: <ADDR>", "Paquete {IDLIKE} para {P}.", "{S} {S}"],
}
#: Words that give a number another meaning.
LABELS = {
    "en": "Shelf mark|Shelf|call no.|catalogue no.|Part no.|part|accession|frame|batch|lot|model|serial no.|drawing|slide|reel|Item|box|offset|key|version|product".split("|"),
    "de": "Regal|Signatur|Standort|Teil|Inventar|Modell|Artikel|Los|Fach|Seriennummer".split("|"),
    "fr": "cote|référence|rayon|modèle|article|lot|pièce|inventaire|numéro de série|étagère".split("|"),
    "es": "signatura|estante|referencia|modelo|artículo|lote|pieza|inventario|número de serie|caja".split("|"),
}
STREETS = {
    "en": "Baker Castle Meadow Abbey Harbour Lime Spring Quarry Garden Forest Royal Lower School Market Windmill".split(),
    "de": "Ahornstraße Rosenweg Burggasse Poststraße Wiesenweg Lindenplatz Seestr. Kastanienallee Turmgasse Feldstrasse Eichenweg Marktplatz Bergstr. Uferweg".split() + ["Am Anger", "An der Kirche", "Zum Hafen", "Alte Gasse"],
    "fr": ["rue du Château", "rue des Roses", "avenue des Pins", "av. de la Mer", "boulevard du Nord", "bd Victor", "place du Marché", "place aux Fleurs", "bd des Alpes", "chemin du Bois", "allée des Cerisiers", "impasse des Jardins", "quai Neuf", "cours du Parc", "rue Sainte-Anne"],
    "es": ["Calle Real", "Calle de la Luna", "C/ San Juan", "C/ del Río", "Avenida de la Paz", "Avda. del Parque", "Avda. de los Pinos", "C/ Mayor Alta", "Plaza de las Flores", "Paseo de la Playa", "Plaza de España", "Plaza del Sol", "Paseo del Prado", "Camino Viejo", "Ronda Norte", "Travesía de la Iglesia"],
}
TOWNS = {"en": ["Fairhaven", "Newbridge", "Oakham", "Milton", "Westford"], "de": ["Neustadt", "Bergheim", "Seedorf", "Kirchberg", "Altenau"], "fr": ["Villefranche", "Beaumont", "Saint-Martin", "Montfort-sur-Mer", "Rochebrune"], "es": ["Villanueva", "Montealto", "Puerto Real", "San Miguel", "Fuente del Monte"]}
MARKS = {
    "phone": {
        "en": ["(###) ###-####", "###-###-####", "###.###.####", "+1 ### ### ####", "+1 (###) ###-####", "1##########", "1##########", "###.###.####", "0## #### ####", "+44 ## #### ####", "+44 (0)## #### ####", "0#### ######", "0044 #### ######", "00## #### ### ###"],
        "de": ["0### #######", "0### / ## ### ##", "(0##) ## ### ###", "0##/#####-###", "+49 (0)### #######", "+49 ## ##### ###", "0049-##-########", "0049-##-#####-##", "0###-#######", "0## ########"],
        "fr": ["0# ## ## ## ##", "0#.##.##.##.##", "0#-##-##-##-##", "0#########", "+33 # ## ## ## ##", "+33 (0)# ## ## ## ##", "0033 # ## ## ## ##"],
        "es": ["### ## ## ##", "###-###-###", "### ### ###", "#########", "+34 ### ### ###", "+34 #########", "0034 #########"],
    },
    "id": {
        "en": ["###-##-####", "### ## ####", "#########", "###-##-####", "AA ## ## ## A", "AA######A"],
        "de": ["## ### ### ###", "###########", "## ###### A ###", "########A###", "A##A##A##", "A########"],
        "fr": ["1 ## ## ## ### ### ##", "2 ## ## ## ### ### ##", "1############", "2##############", "2 ## ## ## ### ###"],
        "es": ["########A", "########-A", "##.###.###-A", "######## A", "## ### ### A", "X#######A", "Y-#######-A"],
    },
}
STYLES = ("(at)", " [at] ", " (at) ", " @ ", " at ")


class Writer:
    """Draws labelled rows; ``lexicon`` maps a language to its given and family names."""

    def __init__(self, lexicon: dict[str, tuple[list[str], list[str]]], seed: int = 7):
        self.r, self.lexicon = random.Random(seed), lexicon

    def digits(self, shape: str) -> str:
        """Every # becomes a random digit, every A a random capital."""
        r = self.r
        return "".join(str(r.randrange(10)) if c == "#" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in shape)

    def place(self) -> str:
        return self.r.choice(PLACE_HEAD) + self.r.choice(PLACE_TAIL)

    def given(self, lang: str) -> str:
        known = self.lexicon.get(lang, ([], []))[0]
        return self.r.choice(known if known and self.r.random() < 0.6 else OTHER_GIVEN[lang])

    def family(self, lang: str) -> str:
        return self.r.choice(self.lexicon.get(lang, ([], []))[1] or ["Miller"])

    def name(self, lang: str) -> Row:
        r = self.r
        g, f, first = self.given(lang), self.family(lang), self.digits("A") + "."
        particle = r.choice(PARTICLES[lang])
        forms = (
            (30, f"{g} {f}"),
            (7, f"{g} {first} {f}"),
            (7, f"{first} {f}"),
            (3, f"{first} {self.digits('A')}. {f}"),
            (11, f"{f}, {g}"),
            (3, f"{f}, {first}"),
            (6, f"{g}-{self.given(lang)} {f}"),
            (6, f"{g} {f}-{self.family(lang)}"),
            (8, f"{g} {particle}{'' if particle[-1] == chr(39) else ' '}{f}"),
            (5, f"{g} {f} {self.family(lang)}"),
            (18, ""),
        )
        text = r.choices([t for _, t in forms], [w for w, _ in forms])[0]
        lead = ""
        if not text:
            lead = r.choice(TITLES[lang]) + " "
            if r.random() < 0.1:
                lead += r.choice(TITLES[lang]) + " "
            text = f if r.random() < 0.8 else f"{g} {f}"
        style = r.random()
        text = text.upper() if style < 0.1 else text.lower() if style < 0.18 else text
        return [(lead, None), (text, "name")] if lead else [(text, "name")]

    def mail(self, lang: str) -> str:
        r = self.r
        plain = lambda s: s.lower().translate(str.maketrans("äöüéèñíóúáëïçâêîô", "aoueeniouaeicaeio")).replace("ß", "ss")
        g, f = plain(self.given(lang)), plain(self.family(lang))
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}-{g}", f"{g[0]}{f}", f"{f}{self.digits('##')}", f"{g}+list", g])
        host = r.choice(["", "", "mx.", "mail.", "lab2."]) + plain(self.place()) + r.choice([".example", ".test", ".invalid", ".org", ".co.example", ".example.net", ".com", ".info"])
        way = r.random()
        if way < 0.55:
            out = f"{local}@{host}"
        else:
            style = r.choice(STYLES)
            word = "dot" if style.strip().isalpha() else ""
            out = f"{local.replace('.', ' dot ')} at {host.replace('.', ' dot ')}" if word else f"{local}{style}{host.replace('.', '(dot)') if style == '(at)' and r.random() < 0.7 else host}"
        return out.upper() if r.random() < 0.1 and " at " not in out else out

    def address(self, lang: str) -> str:
        r = self.r
        n = str(r.randrange(1, 200)) + (r.choice("abc") if r.random() < 0.1 else "")
        street, town, code = r.choice(STREETS[lang]), r.choice(TOWNS[lang]), self.digits("#####")
        gap = r.choice([", ", ", ", ", ", "\n"])
        if lang == "en":
            kind = r.choice("Street Road Lane Avenue Close Way St. Rd Drive Court Square".split())
            return f"{n} {street} {kind}" + r.choice(["", "", f"{gap}{town}", f"{gap}{town} {code}", f"{gap}{town} {self.digits('AA# #AA')}", f"{gap}{town} {self.digits('A## #AA')}"])
        if lang == "de":
            return f"{street} {n}" + r.choice(["", "", f"{gap}{code} {town}"])
        if lang == "fr":
            n += r.choice(["", "", " bis", " ter"]) if n.isdigit() else ""
            return f"{n}{r.choice([' ', ', '])}{street}" + r.choice(["", "", f"{gap}{code} {town}"])
        return f"{street}{r.choice([', ', ', ', ' '])}{n}" + r.choice(["", "", f", {code} {town}", f", {self.digits('#')}º {self.digits('A')}, {code} {town}", f", bajo, {code} {town}"])

    def item(self, slot: str, lang: str) -> Row:
        if slot == "NAME":
            return self.name(lang)
        if slot == "ID":
            out = self.digits(self.r.choice(MARKS["id"][lang]))
            return [(out.lower() if self.r.random() < 0.04 else out, "id_number")]
        if slot == "PHONE":
            out = self.digits(self.r.choice(MARKS["phone"][lang]))
            return [(out.replace(" ", " ") if self.r.random() < 0.05 else out.replace("-", "‑") if self.r.random() < 0.05 else out, "phone")]
        return [(self.mail(lang), "email")] if slot == "MAIL" else [(self.address(lang), "address")]

    def fill(self, slot: str, lang: str) -> str:
        r = self.r
        if slot == "S":
            out = self.speech(lang)
            return out[0].upper() + out[1:] if r.random() < 0.95 else out
        if slot == "W":
            return r.choice([w for group in SPEECH[lang] for x in group for w in x.split()])
        if slot == "DATE":
            day = f"{r.randrange(2015, 2031)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}"
            return r.choice([day, day, day, day.replace("-", "/"), ".".join(reversed(day.split("-"))), day + "T" + self.digits("##:##:##")])
        if slot in ("P", "p"):
            return self.place() if slot == "P" else self.place().lower()
        if slot == "N":
            return str(r.randrange(1, 1000))
        if slot[0] == "D" and slot[1:].isdigit():
            return self.digits("#" * int(slot[1:]))
        if slot == "HEX8":
            return "".join(r.choice("0123456789abcdef") for _ in range(8))
        if slot == "B64":
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randrange(3, 30)))
        if slot == "LABEL":
            return r.choice(LABELS[lang])
        if slot == "IDLIKE":
            return self.digits(r.choice(MARKS["id"][r.choice(["en", "de", "es", "fr"])]))
        if slot == "PHONELIKE":
            return self.digits(r.choice(MARKS["phone"][r.choice(["en", "de", "es", "fr", "fr"])]))
        if slot == "ADV":
            return r.choice(SPEECH[lang][3])
        return self.given(lang) if slot == "G" else self.family(lang)

    def noun(self, lang: str) -> str:
        """A word of the list, or one made up, so that unknown words stand in ordinary text too."""
        r = self.r
        if r.random() < 0.6:
            return r.choice(SPEECH[lang][1])
        out = "".join(r.choice(SYLLABLES) for _ in range(r.choice([2, 2, 3]))) + r.choice(ENDINGS[lang])
        return out.capitalize() if lang == "de" else out

    def thing(self, lang: str) -> str:
        """What an ordinary sentence is about: a thing, a place, a thing of a place or a number of things."""
        r = self.r
        of, way = OF[lang], r.random()
        if way < 0.35:
            return f"{r.choice(SPEECH[lang][0])} {self.noun(lang)}"
        if way < 0.55:
            return self.place()
        if way < 0.8:
            return f"{r.choice(ARTICLES[lang])} {self.noun(lang)} {of} {self.place()}"
        if way < 0.87:
            return f"{r.randrange(2, 1000)} {r.choice(COUNTED[lang])}"
        if way < 0.93:
            return f"{r.choice(ARTICLES[lang])} {self.noun(lang)} {of} {r.choice(ARTICLES[lang])} {self.noun(lang)}"
        return f"{self.noun(lang)} {of} {self.place()}" if lang != "en" else f"the {self.place()} {self.noun(lang)}"

    def speech(self, lang: str) -> str:
        r = self.r
        _, _, doings, when = SPEECH[lang]
        out = f"{self.thing(lang)} {r.choice(doings)} {self.thing(lang)}"
        if r.random() < 0.5:
            out += f" {r.choice(when)}"
        if r.random() < 0.2:
            out = f"{r.choice(OPEN[lang])} {self.place()}{r.choice(['', ',', ':'])} {out}" if r.random() < 0.7 else f"{r.choice(OPEN[lang])} {self.place()}"
        if r.random() < 0.3:
            out += f"{r.choice([', ', '; ', ' '])}{r.choice(JOIN[lang])} {self.thing(lang)} {r.choice(doings)} {self.thing(lang)}"
        return out + r.choice([".", ".", ".", ".", "!", "?", ""])

    def sentence(self, template: str, lang: str) -> Row:
        out: Row = []
        at = 0
        while at < len(template):
            rest = template[at:]
            slot = next((s for s in ("NAME", "PHONE", "MAIL", "ID", "ADDR") if rest.startswith(f"<{s}>")), None)
            end = template.find("}", at)
            if slot:
                out += self.item(slot, lang)
                at += len(slot) + 2
            elif template[at] == "{" and end > 0 and template[at + 1 : end].isalnum():
                out.append((self.fill(template[at + 1 : end], lang), None))
                at = end + 1
            else:
                out.append((template[at], None))
                at += 1
        return out

    def rows(self, count: int, held_out: bool = False) -> list[Row]:
        """``count`` rows of one to four sentences each, evenly over languages and kinds."""
        r, out = self.r, []
        for _ in range(count):
            lang = r.choice(["en", "en", "de", "fr", "es"])
            row: Row = []
            for k in range(r.choice([1, 2, 2, 3, 4])):
                if k:
                    row.append((r.choice([" ", " ", "\n", "\n\n"]), None))
                group = r.choices(["named", "contact", "plain"], [24, 40, 36])[0]
                own = r.choice(["en", lang]) if group == "plain" else lang
                pool = HELD_OUT[own] if held_out else {"named": NAMED, "contact": CONTACT, "plain": PLAIN}[group][own].split("\n")
                part = self.sentence(r.choice(pool), own)
                if group == "plain" and not held_out and (style := r.random()) < 0.16:
                    part = [(t.upper() if style < 0.1 else t.lower(), kind) for t, kind in part]
                row += part
            if r.random() < 0.06:  # what a tool has put out, as JSON
                row = [(r.choice(['{"tool": "', '{"id": "']) + self.place().lower() + r.choice(['", "result": "', '","text":"']), None), *row, ('"}', None)]
            out.append(row)
        return out
