"""Small labelled table for the personal-data tagger: one text a row, entities written as {kind|text}."""

EXAMPLES = [row for row in """
call me at {phone|(499) 555-6503} after five
my phone is {phone|555-123-4567} thanks
phone: {phone|555 010 9988}
tel. {phone|030 1234567} or by mail
tel {phone|089 5550 123} please
mobile {phone|0170 5556677}
fax: {phone|(212) 555-0187} today
you can reach us on {phone|212-555-0143} any day
ring {phone|1-800-555-0199} for help
telefon {phone|040 555 7781} anrufen
appelez le {phone|01 23 45 67 89} demain
llame al {phone|91 555 12 34} hoy
the number is {phone|(303) 555-0111} and it works
text {phone|415.555.0132} now
dial {phone|617.555.0178} at once
his mobile was {phone|(704) 555-2210} until may
phone {phone|+1 (456) 555-2186} or write
tel {phone|+49 30 901820} now
write to {email|anna.berg@mail.example.org} soon
mail {email|info@shop.example.com} for more
contact {email|jo_77@example.net} now
write to {email|peter (at) mail (dot) example (dot) org} please
reach {email|sam (at) example (dot) net} today
e-mail {email|maria [at] example [dot] com} now
send it to {email|bob [at] example [dot] org} tonight
email {email|lee.wong (at) example.com} first
ssn {id|123-45-6789} on file
social security number {id|987-65-4320} was given
her ssn is {id|219-09-9999} there
ssn: {id|078-05-1120} again
iban {id|DE89 3704 0044 0532 0130 00} for the transfer
iban: {id|FR14 2004 1010 0505 0001 3M02 606} please
iban {id|ES91 2100 0418 4502 0005 1332} only
passport {id|X1234567} was lost
passport number {id|C01X00T47} expired
passport no {id|K7654321} found
name: {name|Anna Berg} and I live here
name: {name|Tom Okafor} from the north
name: {name|Maria Lopez} of the team
name: {name|Peter Schmidt}
we met mr {name|Jonas Weber} today
we met mrs {name|Olga Petrova} there
ask dr {name|Chen} about it
ask mr. {name|Brown} about it
dear mrs. {name|Green} we wrote
dr. {name|Amara Nwosu} spoke first
call mr {name|Lee} at {phone|555-867-5309} now
in 1998 about 25 people came
it was 1984 and 12 years later
the price was 19.99 dollars then
version 3.5.2 fixed it
see page 12 of 340 for it
at 10:30 on 2024-01-05 they left
table 4.2 shows 1,234 items in 17 rows
order 4041894974608795 was shipped
item 4337166598464399 and so on
token = "1eb9c654e721b4f8" was set
key=9f8e7d6c5b4a39281706f5e4d3c2b1a0 there
the host 154.127.37.204 answered
from 42.144.35.254 to the end
the and attion to thanedble the anea
it is at the end of the day
he was at home at ten
there is a dot at the end of it
in the house with the name of it
The name was not known at all
Eriner thanea of the and in
Und die der schein von ein mit
Que la de los para una con
Le la des et dans une qui
the### of%%% in$$$ and&&& to*** at###
thanedble | nd | of | in | 12 |
licensed under the Apache License, Version 2.0.
This work is licensed under CC BY-NC 4.0.
chapter 7 of book 3 was long
2 of 3 and 4 or 5 were 100
it rose 3.5% in q4 2023
call it a day and phone home
they email a lot at work
the doctor and the passport were there
tel aviv and the iban system
room 101 at floor 5 of 20
a 5-4 vote and a 10-12 score
Thines and Ble was Ndblein the Blereble
Hetian Ofanndtionre And Lying Edesed
he said at once: go to the dot
Ouing. A tion was Le Le and He He there
It Is Is At At the Reon. Be
The Thedored Er Thouhaan Nding Cion La
Is. Is the To. Eronou Rely. Ofanheshwh and
Heou. Intionble Ouing And Heatin Onndwh
Anerea. Thonbleat The In Du De Und Die
Eran Hethea Ntwhan Thenly Orre Antionor
Thatble Anwh Threan Tihein Nt Toertionouat
Ere Ander Of Thand. Then Ander Was
Le Monde Et La Vie De Paris Au Soir
Der Die Das Ein Tag Im Park Von Ulm
El Sol De La Costa Y Un Perro Gris
New York And San Marino Are Far Away
Table Of Contents And List Of Figures
Ened Thre And Ouer. Ined Atha Or Enth
Sting Inen Reed Thor. Ationes Eather Ised
Big Red Dog. Blue Sky. Green Tree
A. Ed On The Way. Er. En. An
thing Hender of Anthor and Renther was Intion
in Haled or Ereth to Anouth by Stering
at at at at at at at at at at at at
at at. at at. at at. at at. at at. at at.
for for for for for for from from from from from
dot dot dot the the the dot dot in in in of of
to at in to at in to at in at dot at dot at dot
Inble. An the Or. For it Onthnd. Of Rebleth. Hath
Ingonble. Erlylyen and Onat. Eredhe in Th. Be
""".strip().split("\n")]


def plain_rows(rows: int = 60, words: int = 20) -> list[str]:
    """Rows without personal data, of words that occur once each: plain, capitalised (one in six), before stops, with digits."""
    parts = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    out = []
    for row in range(rows):
        line = []
        for place in range(words):
            n = row * words + place
            word = "".join(parts[(n // len(parts) ** k) % len(parts)] for k in range(3))
            word = word.capitalize() if (7 * n + row) % 6 == 0 or (5 * n + row) % 31 < 2 else word
            if n % 7 == 5:
                # Words with digits, numbers, decimals, numbers with a dash or a unit.
                number = str(n * n * 31 % 10 ** (1 + n // 7 % 5))
                word = (word + number, word[:2] + number + word[-1], number, f"{number}.{n % 10}", f"{n % 90}-{number}", number + "km", word[:1].upper() + number)[n // 7 % 7]
            line.append(word + "." if (3 * n + row) % 11 == 0 else word)
        out.append(" ".join(line))
    return out


# Sentences in four languages; capitals in braces are filled in by ``generated_rows``.
SENTENCES = """
my name is {NAME} and i live here
Her name is {NAME} from the north
his name is {NAME}
call {NAME} at {PHONE} now
mein name ist {NAME} und ich bin hier
ihr name ist {NAME}
herr {NAME} kam an
frau {NAME} war dort
mon nom est {NAME} et voila
je m'appelle {NAME} et je vis ici
monsieur {NAME} est venu
madame {NAME} est partie
mi nombre es {NAME} y vivo en casa
me llamo {NAME} y soy de aqui
señor {NAME} fue ayer
señora {NAME} vino hoy
my ssn is {SSN}
the ssn is {SSN} on file
her ssn was {SSN} there
passport number is {PASS} now
passport {PASS} was lost
passport no {PASS} expired
reisepass {PASS} ist weg
passeport {PASS} est perdu
pasaporte {PASS} de ella
dni {DNI} de mi padre
dni: {DNI} hoy
token = "{HEX}" was set
TOKEN = "{UPPERHEX}"!! AND
token: {HEX} for it
secret = "{HEX}" here
secret: {HEX} there
api_key = "{HEX}" of the tool
api_key: {UPPERHEX} too
password: {WORD} for all
password is {WORD} there
passwort: {WORD} und so
""".strip().split("\n")
FIRST = "Jane John Anna Karl Marie Juan Otto Lucia Peter Ines Paul Clara Hugo Rosa Emil Nadia".split()
LAST = "Doe Smith Maier Dupont Garcia Kranz Lopez Weber Martin Novak Rossi Keller Moreau Santos Lang Okoye".split()
QUIET = """
it is The thing and it is On
he is Ondreth and she is Thanly
der name von Haus und Hof ist Alt
el nombre de La casa es Gris
le nom de La rue est Grand
the name of The place is not known
the secret of The house is out
a token of Love and 12 others
the password was not set in 2019
the frau and the herr of der Stadt
call The Thing off at 10
madame and monsieur were there
das ist Ein Haus und es ist Alt
cet homme est La vie et Le jour
la casa es El sol y La luna
the ssn and the dni of no one
token = none and secret = none
hash 9f8e7d6c5b4a392817064f5e4d3c2b1a00112233 of it
commit 1eb9c654e721b4f812088970e66a6345cee33dd6 in the tree
""".strip().split("\n")


def fill(row: str, n: int) -> str:
    """The sentence with the n-th value of each kind."""
    mixed = n * 2654435761 % 2**32
    digits = f"{mixed * 48271 % 10**9:09d}"
    hexes = "".join(f"{(mixed + k * 40503) * 2246822519 % 2**32:08x}" for k in range(5))
    first, last = FIRST[mixed % 16], LAST[mixed // 16 % 16]
    values = {"NAME": ("name", f"{first} {last}" if mixed // 256 % 3 else last), "PHONE": ("phone", f"{digits[:3]}-555-{digits[3:7]}"), "SSN": ("id", f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"),
              "PASS": ("id", f"{chr(65 + mixed % 26)}{chr(65 + mixed // 26 % 26) if mixed % 2 else ''}{digits[:7]}"), "DNI": ("id", digits[:8] + chr(65 + mixed % 26)),
              "HEX": ("secret", hexes), "UPPERHEX": ("secret", hexes.upper()), "WORD": ("secret", f"{last.lower()}{digits[: 2 + mixed % 3]}{first[:2].lower()}")}
    for name, (kind, value) in values.items():
        row = row.replace("{" + name + "}", "{" + kind + "|" + value + "}")
    return row


def generated_rows(copies: int = 10, start: int = 0) -> list[str]:
    """Every sentence with ``copies`` values."""
    return [fill(row, start + copies * i + n) for i, row in enumerate(SENTENCES) for n in range(copies)]


def quiet_rows(rows: int = 6) -> list[str]:
    """The quiet sentences, and link words at the end of a sentence before capitals, after words of all kinds."""
    out = list(QUIET)
    for n, plain in enumerate(plain_rows(5 * rows, 12)):
        link = ("is", "ist", "est", "es", "no")[n % 5]
        a, b, c, d, *rest = plain.replace(".", "").lower().split()
        out.append(f"{a} {link}. {b.capitalize()} {c} {link} {d.capitalize()}. {rest[0].capitalize()} {rest[1]} {link}. {rest[2].capitalize()} {rest[3].capitalize()} {rest[4]}")
    return out
