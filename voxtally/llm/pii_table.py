"""The labelled table that the personal-information model is trained on.

Lines are composed from patterns with slots; the slots are filled by seeded generators, names from the given list and
from new combinations of the list's own beginnings and endings, so that the model learns shapes rather than entries.
Slots: N name, E email, P phone, I identity number, A address. The table's size (LINES) is the bound of the sample.
"""

from __future__ import annotations

import random

LINES = 8000
KINDS = {"E": "email", "P": "phone", "I": "identity", "A": "address", "N": "name"}

#: Written for this table from everyday correspondence, notes and calls; no pattern is taken from the documents.
WITH_SLOTS = """Dear {N},|Hello {N}, thanks for your order.|{T}{N} is out of office until Monday.|Yours sincerely, {N}|Best, {N}|Thank you, {N}|Regards, {N}|Kind regards, {N}|Cheers, {N}|Name: {N}|Full name: {N}|Patient: {N}|Customer: {N}, {P}|Owner: {N}|Author: {N}.|To: {N}|From: {N} <{E}>|Cc: {N} <{E}>, {N} <{E}>
Attendees: {N}, {N} and {N}|Minutes taken by {N}.|{N} opened the meeting at nine.|{N} and {N} agreed to postpone the vote.|The chair, {N}, thanked everybody.|As {N} pointed out, the budget is tight.|{N} was not present.|we asked {N} whether the boiler had been serviced|have you seen {N} lately|this parcel is for {N}, please sign here|{N} moved to Canada last spring.
My daughter {N} starts school in autumn.|Our new neighbour {N} plays the cello.|{T}{N} will see you now.|{T}{N} prescribed a lower dose.|I bought the car from {N} in May.|she married {N} in a small church|he is called {N} and he repairs clocks|i am {N} from accounting|hi this is {N} calling about the fridge|yes, {N} speaking|hello my name is {N}|are you {N}?|"{N}?" asked the guard.|{N} smiled.|{N} nodded and left.
Written by {N}, translated by {N}.|Photograph by {N}.|{N} scored twice before half time.|A song by {N} was playing.|Ask for {N} at the desk.|Speak to {N}.|It was {N} who found the keys.|Nobody believed {N}.|When {N} arrived, dinner was cold.|before {N} could answer the line went dead|the goat belonging to {N} had escaped again|with {N} we walked to the lighthouse|between {N} and the wall stood a bicycle
{N}; {P}|{N}: {E}|{N} | {P} | {E}|{N}, {A}|{N}	{E}	{P}|{N}, born 4 May 1970, {I}|"name": "{N}", "phone": "{P}"|"email": "{E}", "id": "{I}"|name={N}&mail={E}|<td>{N}</td><td>{P}</td>|* {N} ({E})|- {N}, {P}|[{N}] see you there|@{d} {N}: fine by me
Phone: {P}|Tel: {P}|Tel. {P}|Mobile {P}|Fax: {P}|Call {P}.|Call us on {P} any time.|My mobile is {P}|you can text me on {P}|the helpline is {P}, it is free|ring the plumber at {P} or at {P}|In an emergency dial {P}.|for bookings phone {P}|missed call from {P}|WhatsApp: {P}|(phone {P})|the number is {P} and i repeat it is {P}|Reach us by phone ({P}) or mail ({E}).|it rang from {P} twice|voicemail of {P} is full|you hear {P} at the end of the message|he dictated {P} and the line went dead|{P} does not pick up|{A}, {P}|{E}, {P}
Email: {E}|E-mail: {E}|Mail: {E}|Send your application to {E}.|Please reply to {E}|write to me at {E}|contact {E} for details|questions go to {E}, complaints to {E}|you will find me under {E}|my address is {E}, all lower case|forwarded to {E}|unsubscribe: {E}|{E} bounced|{E} has shared a file with you|newsletter@ is closed, use {E}|mailto:{E}|(see {E})|it is {E} without capitals
Passport {I}|Passport no. {I}|Passport number: {I}|ID card {I}|ID: {I}|National ID {I}|Social security number {I}|SSN: {I}|my social is {I}|Tax number {I}|tax ID {I} appears on the form|NI number {I}|National insurance: {I}|the insurance number {I} was refused|Identity card no {I} expired|Personal number {I}|please confirm that {I} is your tax code|he entered {I} in the passport field|DNI {I}|CPF: {I}|NIF {I}|PESEL {I}|her id ends up being {I}|copy of passport {I} attached|mention {I} in your reply|under the number {I} you can follow your claim|{I} is printed on the card|hers starts like this, {I}|and the number is {I}, she said|{I} was rejected, try again|taxpayer {I}, refund approved
Address: {A}|Home address: {A}|Ship to {A}.|Deliver it to {A}, please.|We live at {A}.|the office is at {A}|come to {A} at eight|the taxi took me from {A} to {A}|A fire broke out at {A}.|Flat for rent: {A}|Invoice address: {N}, {A}|{A}|{N}|{P}|{E}|{I}|the house at {A} was sold|Meet at {A}|she grew up in {A}, above a bakery|Visit our shop, {A}, open daily|return the key to {N}, {A}|our branch in {A} closes at noon|i stay at {A} until sunday|{A} used to be a cinema|Her letter gives {A} as the sender.|{A} is for sale|lives at {A} with two cats|born at {A}|spelled {A} on the label
Die Praxis liegt in {A}.|Wir wohnen {A}.|Frau {N} ist unter {P} erreichbar.|Herr {N} bittet um Rückruf.|Mit freundlichen Grüßen, {N}|Nous habitons {A}.|Madame {N} est absente.|Appelez le {P}.|Écrivez à {E}.|Cordialement, {N}|Vivo en {A}.|Escríbame a {E}.|Llámame al {P}.|Saludos, {N}|O meu telefone é {P}.|Moro em {A}.|Napisz do mnie: {E}.|Zadzwoń pod {P}.|Позвоните {P}.|Почта: {E}.|电子邮件:{E}。|请拨打{P}。|メールは{E}まで。|電話番号:{P}|Señor {N}, su pedido está listo.|Steuernummer {I}|Ausweis {I}|passeport {I}|pasaporte {I}""".replace("\n", "|").replace(" | {P} | ", " ¦ {P} ¦ ").split("|")
WITH_SLOTS = [x.replace("¦", "|") for x in WITH_SLOTS]

WITHOUT = """The train leaves at 14:0{d} from platform {d}.|Version {d}.{d}.1 fixes the crash on start.|Chapter {d} begins with a storm.|Invoice 2023-00{d}17 is due on 2023-04-{d}.|Order no. 88{d}213 has been shipped.|It costs 1,2{d}9.50 euros.|Temperature fell to -{d}.5 degrees.|The score was {d} to {d}.|ISBN 978-3-16-1484{d}0-0|Error 0x80{d}70057 at line {d}12
Room {d}04 is on the second floor.|Flight LH{d}34 is delayed.|The court case 12/{d}4/2019 was closed.|Take bus {d} and get off at the Museum Square stop.|In 19{d}8 the bridge was rebuilt.|Batch A{d}-{d}07-C passed|uuid 3f2a-11{d}b-9c0d-77e1|sha 4be1{d}9c0f2|pip install parser@{d}.{d}.1|@property def size(self)|follow @weather for updates|rate 3 @ 2.5 kHz|meet @ noon|tag v{d}.0-rc{d} was pushed
one two three go|three out of four dentists|page ten of the atlas is missing|double the dose, then wait one hour|nine hundred people came|zero tolerance is one of the rules|he counted one two three four five and jumped|twenty one of the forty five seats|press one for sales or two for service|1 2 3 4 5 6 7 8 9|0.25, 0.50, 0.75|10 100 1000 10000|3.14159 26535 89793|The backup of 202305{d}7 finished.|Random state 20210{d}12 was used.|snapshot 2019{d}04 is gone|cluster {d}0402{d}11 restarted|The log 2018{d}1{d} has no errors.|account balance 1{d}250{d}00|IMG_2021{d}04_0023{d}.jpg is blurred|see scan_00{d}417_0.25_3_b.pdf|backup_{d}0{d}223_final|tracking code 4{d}7 1{d}3 556 02 4|serial 000{d}-1{d}2-77
Lake Geneva was calm.|The Black Forest is in the south.|Mount Everest and the North Pole|New Year's Eve in Hong Kong|The Deutsche Bank tower|Bank of England raised rates.|World Health Organization|United Nations report|Annual General Meeting|Terms and Conditions|Frequently Asked Questions|Quick Start Guide|Happy Birthday!|Good Morning Everyone|Best Wishes|Kind Regards|Many Thanks|Warm Regards,|Dear Sir or Madam,|Dear All,|To Whom It May Concern|Ladies and Gentlemen
Human Resources Department|Chief Executive Officer|Prime Minister|Saint Nicholas Day|Golden Gate Bridge|The Old Town Hall|High Court Judge|Grand Hotel Europa|Red Cross|Star Wars|Machine Learning|Data Processing Agreement|Personal Computer|Part Two|Final Version|Table {d}: Results|Figure {d} shows the trend.|Section {d}.{d} Overview|Monday Morning Blues|Christmas Market|Winter Sale|Open Day
{G} street food is popular.|The {S} Institute opened a new wing.|{S} Road is closed for repairs.|the {S} theorem|a {S} class ship|{G} is a common word here.|Project {G} was cancelled.|The {S} dataset has {d}00 rows.|hotel {G}|The {S} effect is small.|Room {S} is booked.|the {G} model scored {d} points|{S} et al. disagree|{G}, {G} and {G} are rivers|Cafe {S} closes at six.|{S} Street is noisy.|{S} Corpus, part {d}|Lab {S}, second door
The flat is on the third floor.|Turn left into the narrow lane and walk uphill.|A square has four sides.|The road was wet and the avenue empty.|we crossed the place at night|drive slowly down the hill|close the window and the door|the court rejected it|a row of gardens behind the terrace|his way home|street lamps were lit|rue is a bitter herb|via Rome to Naples
Please mail the letter at once.|Call me later.|The phone is broken.|My number one reason|Her identity was never known.|the passport office is shut|she lost her passport and her social life|tax returns are late|at dot com prices|meet me at the dot on the map|look at example dot|email is down today|write an address on the envelope|name the file properly|ID cards are checked at the gate
He has been working in the garden since early morning.|Rain is expected in the evening.|Do not feed the birds.|When the light is green, walk.|The cat slept under the oven.|Somebody left a red umbrella on the train.|We need more chairs and fewer speeches.|All tickets are sold.|What a strange idea!|Nobody knows how old the tree is.|After lunch the children built a raft.|An empty glass stood on the piano.|Could you pass the salt?|i have no idea what you mean|it was raining and we were late again|nobody returned to fetch the wheelbarrow
The engine makes a loud noise above forty miles per hour.|Two thirds of the votes were counted by midnight.|Every student gets a key.|Bring warm clothes and a torch.|This recipe needs butter, flour and three eggs.|Old houses creak at night.|Their boat sank near the island.|Nurses and drivers went on strike.|A quiet tune came from the kitchen.|A tailor, two bakers and one judge met at noon.|the secretary typed a long report|my uncle sold his farm|An Italian tenor sang|The Spanish teacher and her French colleague|English, German and Polish are spoken here.
Es regnet seit gestern.|Der Zug nach Berlin hat Verspätung.|Bitte nicht rauchen.|Die Sitzung am Montag fällt aus.|Wir haben das Haus verkauft.|Am Abend wird es kalt.|Zum Glück ist nichts passiert.|Das Ergebnis der Prüfung liegt vor.|Il pleut depuis hier.|Le train pour Lyon est en retard.|La réunion de lundi est annulée.|Nous avons vendu la maison.|La place est libre.|Está lloviendo desde ayer.|La reunión del lunes se cancela.|El tren sale a las {d}.|La calle estaba vacía.|O comboio está atrasado.|A reunião foi adiada.|Pada deszcz od wczoraj.|Pociąg jest spóźniony.|Zebranie odwołano.|Со вчерашнего дня идёт дождь.|Поезд опаздывает.|昨天开始下雨。|会议取消了。|昨日から雨が降っています。|会議は中止です。""".replace("\n", "|").split("|")

#: Common street and town names, words of streets in other languages, and domains that are reserved for examples.
STREETS = "Oak|Maple|Elm|Willow|Victoria|Albert|Park|Bridge|Church|School|Mill|Spring|Meadow|River|Lake|High|Main|Broad|Green|King's|St John's|St Mary's|North|South|West End|Upper Park|Lower Green|Cherry Tree|Rose Hill|Windmill|Market|Castle|Forest|Sunset|Highland|Washington|Lincoln|Grange|Manor|Abbey|Vicarage|Orchard".split("|")
TYPES = "Street|St|Road|Rd|Lane|Avenue|Ave|Way|Row|Mews|Court|Crescent|Terrace|Drive|Close|Square|Place|Gardens|Hill".split("|")
TOWNS = "Ashford|Millbrook|Riverton|Lindale|Newbridge|Greenfield|Oakham|Springfield|Westbury|Little Marlow|Stoke-on-Sea|Upper Heath|Kirkdale|Holmwood|Marston|Redcliff".split("|")
FOREIGN = ["Calle del {w}", "Calle de la {w} {w}", "Calle {w}", "Avenida {w}", "Avenida de {w}", "Plaza del {w}", "Rua {w}", "Rua do {w}"]
FRENCH = ["rue des {w} {w}", "rue du {w}", "rue de la {w}", "avenue de la {w}", "place {w}", "boulevard {w}"]
GERMAN_END = "straße|strasse|gasse|weg|allee|platz".split("|")
WORDS = "Prado Olmo Iglesia Mercado Rosal Norte Mayor Jardín Lilas Écoles Marché Rosiers Église Midi Pasteur Linden Bahnhof Schul Berg Haupt Mühlen Wald Ring Ufer Flores Rei".split()
DOMAINS = "example.org example.com example.net inbox.example.org acme.example city-clinic.example shop.test school.test club.invalid team.example.net data.example.edu".split()
DIGIT = "zero one two three four five six seven eight nine".split()


class Maker:
    def __init__(self, given: list[str], surnames: list[str], seed: int = 5) -> None:
        self.r = random.Random(seed)
        self.given, self.sur = given or ["Alice", "Martin"], surnames or ["Walker", "Fischer"]
        self.parts = {k: self._ends(v) for k, v in (("g", self.given), ("s", self.sur))}

    @staticmethod
    def _ends(names: list[str]) -> tuple[list[str], list[str]]:
        return [n[: max(3, len(n) // 2)] for n in names], [n[max(3, len(n) // 2) :] for n in names]

    def _new(self, k: str) -> str:
        a, b = self.parts[k]
        return (self.r.choice(a) + self.r.choice(b)).replace(" ", "")

    def g(self) -> str:
        return self.r.choice(self.given) if self.r.random() < 0.6 else self._new("g")

    def s(self) -> str:
        s = self.r.choice(self.sur) if self.r.random() < 0.6 else self._new("s")
        x = self.r.random()
        return "Mac" + s if x < 0.03 else "O'" + s if x < 0.06 else "Mc" + s if x < 0.07 else s

    def name(self) -> str:
        r, x = self.r, self.r.random()
        g, s, i = self.g(), self.s(), r.choice("ABCDEFGHKLMNOPRSTUVWZ")
        if r.random() < 0.12:
            s = r.choice(["de", "van", "von", "del", "di", "la", "der"]) + " " + s
        elif r.random() < 0.08:
            s = s + "-" + self.s()
        n = f"{g} {s}" if x < 0.55 else f"{s}, {g}" if x < 0.75 else f"{g} {i}. {s}" if x < 0.84 else f"{i}. {s}" if x < 0.97 else f"{i}.{r.choice('ABCD')}. {s}"
        y = r.random()
        return n.upper() if y < 0.06 else n.lower() if y < 0.12 else n

    def email(self) -> str:
        r = self.r
        g, s = self.g().lower(), self.s().lower().replace("'", "")
        n = r.randrange(1, 1000)
        local = r.choice([f"{g}.{s}", f"{g}-{s}", f"{s}.{g[0]}", f"{g[0]}{s}", f"{g}{n}", f"{s}_{n:02}", f"user{n:02}", f"{g}+{r.choice(['news', 'work', 'x'])}", f"{g}.{s}-{self.s().lower()}", f"{s}", f"info{n}"])
        d = r.choice(DOMAINS)
        at, dot = r.choice([("@", ".")] * 6 + [("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        if at == " at " and r.random() < 0.6:
            local = local.replace(".", " dot ").replace("_", " underscore ").replace("+", " plus ").replace("-", " dash ")
        dash = " dash " if at == " at " and r.random() < 0.5 else "-"
        e = local + at + d.replace("-", dash).replace(".", dot)
        x = r.random()
        return e.upper() if x < 0.08 else e.title() if x < 0.12 else e

    def spoken(self, digits: str) -> str:
        r, out, i = self.r, [], 0
        oh = r.random() < 0.4
        name = lambda d: "oh" if d == "0" and oh else DIGIT[int(d)]
        double = r.random() < 0.7
        while i < len(digits):
            if double and digits[i] == digits[i + 1 : i + 2]:
                out += ["double", name(digits[i])]
                i += 2
            else:
                out.append(name(digits[i]))
                i += 1
        return " ".join(out)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def made_up(self) -> str:
        """A word of two or three syllables that is in no list."""
        r = self.r
        return "".join(r.choice("b c d f g h k l m n p r s t v w br cl dr fl gr pl sh st th tr".split()) + r.choice("a e i o u ee oo ai".split()) + r.choice(["", "n", "r", "l", "s", "ck", "m"]) for _ in range(r.choice([1, 2, 2, 3]))).title()

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def phone(self) -> str:
        r, d = self.r, self.digits
        forms = ["+44 7### ### ###", "07### ######", "07#########", "+447#########", "01## ### ####", "020 #### ####", "+44 20 #### ####", "(01###) ######", "01### ### ###", "01### ######", "(0#) #### ####", "+61 4## ### ###", "+614########", "(###) ###-####", "###-###-####",
                 "###.###.####", "##########", "+1 ### ### ####", "1-###-###-####", "+33 # ## ## ## ##", "0# ## ## ## ##", "0#########", "+33#########", "+49 1## #######", "+49 ### ##### ##", "0## #######", "0049 ## ### ###", "00## ### #######", "+48 ### ### ###", "00 44 ### ### ####", "0049-##-#####", "00##-##-########",
                 "+34 ### ## ## ##", "+351 ### ### ###", "+7 ### ###-##-##", "+86 1## #### ####", "0#-####-####", "0##########", "0##########", "0##########", "1##########", "00###########", "+44 (0)### ### ####", "+49 (0)## #######"]
        p = "".join(d(1) if c == "#" else c for c in r.choice(forms))
        if r.random() < 0.3:
            plain = "".join(c for c in p if c.isdigit())
            return ("plus " if p[0] == "+" else "") + self.spoken(plain)
        return p.replace(" ", " ") if r.random() < 0.05 else p.replace(" ", r.choice("-.")) if r.random() < 0.05 else p

    def identity(self) -> str:
        """Passport, tax, insurance and identity numbers in the forms of several countries."""
        r, d = self.r, self.digits
        letters = "ABCDEFGHJKLMNPRTXYZ"
        forms = ["##.###.###-#", "##.###.###-A", "###.###.###-##", "A########", "A#######", "A######", "AA#######", "AA######", "########-A", "########A", "#########A", "AA ## ## ## A", "AA######A", "###-##-####", "###-##-####", "###-##-####", "### ## ####", "###########", "AA##A####A", "## ### ###-##", "##-#######"]
        x = r.random()
        if x < 0.12:
            return self.spoken(d(9))
        v = "".join(d(1) if c == "#" else r.choice(letters) if c == "A" else c for c in r.choice(forms))
        return v.lower() if r.random() < 0.1 else v

    def address(self) -> str:
        r, x = self.r, self.r.random()
        n = str(r.randrange(1, 260))
        if r.random() < 0.05:
            n += r.choice("abc")
        if x < 0.72:
            if r.random() < 0.15:
                n = self.spoken(n.rstrip("abc"))
            y = r.random()
            street = r.choice(STREETS) if y < 0.5 else r.choice(self.sur) if y < 0.65 else self.made_up() + r.choice(["", "", " " + self.made_up(), "'s"])
            a = f"{n} {street} {r.choice(TYPES)}" + "." * (r.random() < 0.05)
            if r.random() < 0.2:
                a = f"{r.choice(['Flat', 'Unit', 'Apt', 'Apartment', 'Suite'])} {r.randrange(1, 40)}, {a}"
            if r.random() < 0.45:
                a += f", {r.choice(TOWNS)}"
                if r.random() < 0.6:
                    a += f" {r.choice(['VV', 'ZX', 'QZ'])}{r.randrange(100) if r.random() < 0.5 else r.randrange(10)} {r.randrange(10)}{r.choice(['ZZ', 'KV', 'JJ', 'QD'])}"
        elif x < 0.82:
            a = r.choice(FOREIGN)
            while "{w}" in a:
                a = a.replace("{w}", r.choice(WORDS), 1)
            a += f" {n}" + (f", {self.digits(5)} {r.choice(TOWNS)}" if r.random() < 0.4 else "")
        elif x < 0.91:
            a = r.choice(FRENCH)
            while "{w}" in a:
                a = a.replace("{w}", r.choice(WORDS), 1)
            a = f"{n}{r.choice([', ', ' '])}{a}" + (f", {self.digits(5)} {r.choice(TOWNS)}" if r.random() < 0.7 else "")
        else:
            a = f"{r.choice(WORDS)}{r.choice(GERMAN_END)} {n}" if r.random() < 0.7 else f"{r.choice(['Am', 'Am', 'Zum', 'An der'])} {r.choice(['Alten ', 'Neuen ', ''])}{r.choice(WORDS + ['Markt', 'Bach'])} {n}"
            a += (f", {self.digits(5)} {r.choice(TOWNS)}" if r.random() < 0.7 else "")
        return a.lower() if r.random() < 0.12 else a.upper() if r.random() < 0.03 else a

    def line(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A line and its labelled spans (start, end, slot)."""
        r = self.r
        pattern = r.choice(WITH_SLOTS) if r.random() < 0.76 else r.choice(WITHOUT)
        whole = r.random()
        text, spans, i = "", [], 0
        while i < len(pattern):
            if pattern[i] == "{" and pattern[i + 1 : i + 3][-1:] == "}":
                k = pattern[i + 1]
                if k in KINDS:
                    v = {"N": self.name, "E": self.email, "P": self.phone, "I": self.identity, "A": self.address}[k]()
                    spans.append((len(text), len(text) + len(v), k))
                else:
                    v = {"d": lambda: self.digits(r.choice([1, 2])), "T": lambda: r.choice(["Mr ", "Ms ", "Dr ", "Mrs ", "Dr. ", "Prof. "]), "X": lambda: r.choice(self.sur + self.given), "S": self.s, "G": self.g}[k]()
                text += v
                i += 3
            else:
                text += pattern[i]
                i += 1
        if whole < 0.22 and len(text.lower()) == len(text):
            text = text.lower()
        elif whole < 0.25 and len(text.upper()) == len(text):
            text = text.upper()
        return text, spans

    def document(self) -> tuple[str, list[tuple[int, int, str]]]:
        """One to three lines below or behind each other."""
        text, spans = "", []
        for k in range(self.r.choice([1, 1, 2, 3])):
            if k:
                text += self.r.choice([" ", "\n", "  ", "\n- ", "\n\n"])
            t, s = self.line()
            spans += [(a + len(text), b + len(text), x) for a, b, x in s]
            text += t
        return text, spans


def table(given: list[str], surnames: list[str], lines: int = LINES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    m = Maker(given, surnames)
    return [m.document() for _ in range(lines // 2)]
