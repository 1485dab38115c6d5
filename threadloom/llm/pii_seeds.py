"""The labelled table that the personal-data model is trained from: carrier sentences, plain sentences and value patterns.

Every carrier marks its value by ``{kind}``. Values are drawn by rule from the small pools below, so the table is as large as the number
of sentences asked for, and always the same for a seed. Nothing here is taken from real people.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "person_name")

GIVEN = (
    "Anika Zoltan Tomas Noor Soren Quentin Renata Dario Elin Uma Kofi Ole Lukas Mina Ivo Anna Agnes Amara Aisha Alice Ben Bruno Boris Carla Clara Chen Daniel David Diego Elena Emma Erik Eva Fatima Felix Frank Greta Georg Grace Hanna Hassan Hugo Ines Ivan Adam Aaron Abdul Albert Alex Ali Andrea Andrew Angela Antonio Arjun Arthur Astrid Barbara Beatriz Bilal Birgit Brigitte "
    "Jack Jana Jonas Judith Julia Karim Kenji Lara Laura Leila Linda Lukas Lucia Marta Maria Mei Mark Nadia Nina Nils Olga Oskar Omar Pablo Paul Peter Petra Priya Rafael Renata Rosa Ruth Carlos Caroline Catherine Charles Chloe Christian Christine Daisy Dmitri Dora Edgar Elif Elisabeth Emil Emily Enrique Esther Farid "
    "Samir Sara Simon Sofia Tariq Thomas Tina Vera Victor Walter Wei Xavier Yara Yusuf Yuki Zoe Pedro Luis Carmen Jose Juan Ana Miguel Claire Pierre Marie Luc Camille Heidi Klaus Jürgen Sven Ingrid Fernando Francesca Gabriel George Gloria Hans Hamid Helen Henry Hiroshi Ibrahim Ida Igor Isabel Jacob James Jasmine Javier "
    "Jean John Josef Karl Kate Kwame Lena Leo Lin Liam Lucas Magda Manuel Marco Martin Mateo Max Michael Mohammed Monika Nora Oliver Otto Patrick Philip Ravi Robert Rosalind Sandra Sanjay Sarah Sebastian Sergei Stefan Susan Sven Tatiana Teresa Theo Ute Valeria Viktor Wanda William Yasmin Ying"
).split()
_SUR_A = "Bern Hol Mar Kel Dra Obel Brand Lind Varg Whit Sorr Quil Tol Plim Fel Gart Has Nor Stein Wick Rav Mon Cast Zab Lur Fozz Wex Ester Thorn Ash".split()
_SUR_B = "berg dahl escu gren hurst ini ley lund man mere ric sen son stead strom ström ton vold well wick worthy berry mann feld ez ova aldo er row".split()
_PLAIN_SUR = "Smith Jones Brown Müller Schmidt García López Martin Dubois Rossi Novak Kowalski Patel Khan Nguyen Kim Silva Santos Jensen Larsen Okafor Mensah Sato Tanaka Weber Fischer Moreau Petit Wang Li Singh Kumar Ivanov Popescu Hernández Öztürk Åkesson O'Brien O'Neill MacDonald McCarthy Haddad Cohen Levi Suzuki Park Choi Tran Pham Diaz Costa Ferreira Bianchi Nielsen Virtanen Horváth Murphy Clarke Walker Dupont Lefèvre Keller Vogel".split()
#: Syllables of made-up names: a name need not be known to be one.
_ON = "b br c ch d dr f fr g gr h j k kr l m n p pr r s sh st t tr v w y z kw mb nd th sv bj þ ş ø".split()
_MID = "a e i o u a e i o u ai ia ei ou ö ü á é í ó ã å ø".split()
_OFF = ["", "", "", "n", "r", "l", "s", "k", "m", "t", "nd", "rt", "ng", "sh"]

CARRIERS = {
    "email": [
        "it goes to {}", "answer to {}", "mail to {}", "reply to {}", "forward it to {}", "{} is my login", "user name {}", "schreib an {}", "escribe a {}", "écrivez à {}", "from {}",
        "my email is {}", "write to {} please", "account mail: {}", "it's registered with {}", "login {} won't work", "you can reach me at {}", "({})", "{}", "mail me: {}", "e-mail {}", "the address on the account is {}",
        "contact {} for details", "send it to {} thanks", "signed up as {}", "mi correo es {}", "meine Mail ist {}", "mon adresse mail est {}", "<{}>", "email: {}", "cc {}", "login <{}> won't work", "user {} can't log in",
    ],
    "phone": [
        "phone me under {}", "my cell: {}", "Rückruf unter {}", "bitte anrufen: {}", "mi móvil es {}", "appelez-moi au {}", "number: {}", "dial {}", "{}", "contact number {}",
        "call me on {}", "my number is {}", "tel {}", "mobile {}", "phone: {}", "text {}", "ring {} after 6", "{} is the best number", "you can reach me on {}", "sms to {}", "whatsapp {}", "cell {}", "fax {}", "Tel.: {}",
        "mi teléfono es {}", "meine Nummer ist {}", "mon numéro est le {}", "Handy {}", "call {} please", "phone {}", "landline {}", "reach us at {}", "on {} any time",
    ],
    "id_number": [
        "{}",
    ],
    "address": [
        "I live at {}", "moved to {}", "address: {}", "billing address {}", "ship the card to {}", "we're at {}", "{} is where the speaker sits", "my address is {}", "delivery to {}", "send the parcel to {}", "vivo en {}", "ich wohne in {}",
        "j'habite au {}", "postal address {}", "home address: {}", "deliver to {}", "it was sent to {}", "I am at {} now", "invoice address {}",
    ],
    "person_name": [
        "my name is {}", "this is {}", "account is under {}", "my partner {} has the same", "{} has the same", "ask for {}", "name on the card: {}", "the holder is {}", "I'm {}", "– {}", "— {}", "regards, {}", "Hey {},", "Dear {},", "Hi {},", "Hello {},", "thanks, {}",
        "signed {}", "my wife {} pays for it", "my son {} uses it", "booked by {}", "registered to {}", "me llamo {}", "soy {}", "ich heiße {}", "mein Name ist {}", "je m'appelle {}", "Sehr geehrter {},", "Hola {},", "Liebe {},", "in the name of {}", "- {}", "cheers {}", "contact person {}",
        "my friend {} told me", "I spoke to {} yesterday", "best, {}", "{} speaking", "it belongs to {}", "please call {} back", "my colleague {} will look at it", "my daughter {} cannot open it", "my brother {} as well", "ship it to {}", "{} wrote to us", "{} asked for a refund", "{} is waiting for an answer", "we talked to {} on the phone", "sent to {}", "greetings from {}", "kind regards\n{}", "yours, {}", "best wishes, {}", "Good day, {} here", "Good evening {},", "Hallo {},", "Bonjour {},", "Estimada {},", "Cher {},", "ich bin {}", "yo soy {}", "c'est {}", "Gruß {}", "un saludo, {}", "for {}", "the owner, {}, said so", "tell {} that it works", "user {}", "customer {}", "passenger {}", "Hi {}! It is back", "Thanks {}. Which one is it", "Dear {}, could you look", "{}, are you there", "{}, {phone}", "Dear {}, we have done it", "Hello {}, your case is closed", "deliver to {}, {address}", "{}, {address}", "my boss {} pays", "his name is {}", "her name was {}", "named {}", "with {} and the kids", "says {}", "signed by {}", "from {}", "{} called", "invite {} to the plan", "remove {} from the plan", "name: {}", "{} here", "account holder {}", "under the name {}", "my husband {} is the owner", "call it {}'s account", "Thanks {}.", "Thank you {},", "Ok {}, we are on it", "Sorry {}!", "Morning {},", "Good news {}!",
    ],
}

#: Carriers whose value is a number of the stated kind.
ID_CARRIERS = {
    "ssn": ["my ssn is {}", "SSN {}", "SSN: {}", "ssn {}", "social {}", "social security no. {}", "social security number {}", "my social is {}"],
    "nino": ["NINO: {}", "national insurance {}", "NI number {}", "nino {}", "my NI no. is {}"],
    "tax": ["tax id {}", "Steuer-ID {}", "my tax number is {}", "tax id no. {}", "Steuernummer {}", "TIN {}", "numéro fiscal {}"],
    "passport": ["passport {}", "my passport no is {}", "passport number {}", "Reisepass {}", "pasaporte {}", "passeport {}", "Ausweisnummer {}", "Ausweis {}", "Personalausweis {}", "passport no. {}"],
    "licence": ["driver's license {}", "driving licence {}", "licence no. {}", "my license is {}", "Führerschein {}", "permis {}", "carnet de conducir {}", "driving license number {}", "DL {}"],
    "national": ["my national id is {}", "dni: {}", "DNI {}", "my DNI is {}", "NIE {}", "national id {}", "id card {}", "identity number {}", "ID no. {}", "CURP {}", "personal number {}", "my id number is {}", "número de identidad {}", "identity card {}", "Identity card no. {}"],
}

# Pools of things that are no persons: bands and songs are made from two of them, so that no one name is learnt.
_ADJ = "Crimson Hollow Silver Midnight Broken Electric Golden Northern Wooden Quiet Distant Burning Frozen Hidden Lazy Marble Nervous Purple Rusty Sleepy Sudden Velvet Wild Yellow Copper Glass Paper Tin Salt Low Static Green Old Little".split()
_NOUN = "Lanterns Tigers Kites Foxes Anchors Bridges Candles Daughters Engines Feathers Gardens Harbour Islands Jackals Kettles Ladders Mirrors Needles Orchard Pilots Quarry Rivers Sailors Towers Umbrellas Valley Wolves Owls Ferries Choir Parade Orchestra Sisters Brothers Comet Row Street Road Avenue Lane".split()
_SONG = ["Over the Rooftops", "Winter in Green", "Letters From Nobody", "Dancing Slowly", "A Room of Rain", "The Last Tram", "Hey Sister", "Call Me Later", "Twelve Moons", "Street of Dust", "Down by Mill Road", "Saturday Again", "Blue Avenue", "Sunday Drive"]
_PLACES = "Rotterdam Aberdeen Valencia Toulouse Hamburg Cracow Bergen Austin Denver Toronto Perth Bristol Cardiff Bilbao Nantes Dresden Salzburg Verona Ghent Tampere Westbrook Ashford Millhaven Oakridge Eastport Stonebury Larkfield Porto Fenwick Marston Holmby Kirkwall".split()

#: Sentences without personal data, hard cases among them. ``{band}``, ``{song}``, ``{place}`` and ``{dN}`` (N digits) are drawn.
PLAIN = [
    "any progress with ticket {d4}-{d4}", "Case {d4}-{d5} was marked as done but is not", "my order {d4}-{d4}-{d3} is missing", "the serial is TH{d7}", "please note your case {d4}-{d2}", "Ref {d4}-{d4} {d2}", "invoice {d8}", "it shows code {d3}", "order {d7} has not been sent", "reference {d4} {d4} {d2}", "ticket number {d6}", "your case number is {d5}-{d4}",
    "since Tuesday AX{d3} on the TV box", "error E-{d3}", "now #{d3} on the phone", "err {d3}", "version {d1}.{d1}.{d3}", "they took {d1}.{d2} from me two times", "the bill says {d2}.{d2} although I cancelled", "about {d2} songs are gone", "firmware {d1}.{d2}.{d2} build {d5}", "part no. {d3}-{d4}", "SKU {d8}", "coupon {d4}{d4}", "the licence key of the app is wrong",
    "{d2} 000 000 views", "{d2} 000 000 streams", "{d2} 000 000 times heard so far", "{d1} 000 000 fans", "{d3} 000 000 people listen", "{d1},{d3},{d3} listeners", "from {d2}-{d2} until {d2}-{d2}", "it last worked on 2022-{d2}-{d2}", "the log of {d2}/{d2}/2022, {d2}:{d2}", "parcel tracking {d10}", "transaction {d9}", "model no. {d6}", "barcode {d12}", "room {d3}", "the IMEI does not match", "build {d6}", "list {d8}", "error 0x{d8}", "track {d2} of {d2}", "page {d3} of the manual",
    "the album {d2} {band} by {band}", "their song {d2} {band}", "the {band} mix", "the {band} session", "songs by {band} are mixed up", "the record {song} by {band}", "a remix called {d2} {song}", "play {song} please", "the live version of {song}", "tickets for {band} in {place}", "I miss {band} so much", "{band} and {band} are touring together", "covers of {song} everywhere", "the band {band} left the catalogue", "the singer of {band} is great", "why did {band} vanish", "'{band}' stops after {d2} seconds",
    "where did {song} go", "the video of {band}", "concert of {band}", "new single from {band}", "artist page of {band} is empty", "{song} is skipped every time", "the podcast {song} has no sound", "a list called {band}", "by {band}",
    "it fails since we live in {place}", "does it work in {place}", "hello from {place}", "this week we are in {place}", "on the train to {place}", "the weather in {place} is awful", "people from {place} report the same", "moving to {place} soon", "since moving to {place}", "after our move to {place}", "after moving to {place} it broke", "gone in {place}", "is it down in {place}", "lost signal in {place}", "since I arrived in {place}", "the outage in {place}", "we left {place} last year", "our office in {place}", "the shop in {place} is closed", "greetings, {place}", "near {place}", "we drove from {place} to {place}",
    "@TuneHarborCares are you there", "@{d6} me too", "cc @{d6} and @{d6}", "@SomeShopHelp please look", "thanks @RadioDesk", "/RB", "^PN", "-HC", "/TS", "^AW", "/KD", "- MO", "be right back /JV", "tell us how it goes ^AW", "/EL", "^KM", "-TJ", "~SP",
    "am I the only one", "no idea why", "it started two days ago", "a restart did nothing", "the watch says {d1}.{d1}.{d3}", "the old computer was better", "no, I will not clear anything again", "so annoying", "new password, same story", "how do I leave the family offer", "the last redesign is ugly", "morning all, my battery is empty after one podcast", "the phone and the tablet disagree", "downloads do not open on the plane", "no invitation for students came",
    "I cannot pass the first screen", "news?", "please repair", "Thanks", "Cheers", "Help", "did that", "fine now", "thank you!", "me as well", "yes", "nothing new", "DM sent", "will do", "ok perfect", "Sounds good", "No worries", "Not yet", "Maybe tomorrow",
    "look at [URL] or [EMAIL]", "we hold [EMAIL] and [PHONE]", "we wrote to [CUSTOMER]", "over mobile data it is the same", "my neighbour sees it too", "the bundle of my partner ended", "two people pay too much", "Open Settings > Privacy and read us the last line", "What does the tablet run", "A restart of the player helps now and then", "[NAME] and [ADDRESS] were removed",
    "So sorry. Sign out, count to {d2} and sign in", "We are here to help! The playback people know about it", "Hello! You find gift cards under Shop > Codes", "Good catch. The invoice team checks it this afternoon", "Noted. Is all well again", "we have on record:", "we wrote down:", "please confirm:", "data on your account:", "Alright. Does it help when you turn it off", "Hi again, any change",
    "wieso wurden {d2}.{d2} doppelt berechnet", "die App geht dauernd zu", "{band} fehlt auf einmal", "ständig Fehler {d3}, wieso", "hola, en la tele no suena nada", "han cobrado {d1}.{d2} de más", "la app se apaga sola", "on m'a pris {d2}.{d2} de trop", "encore l'erreur AX{d3}", "plus de {band} depuis lundi", "où est donc {band}", "où sont passés les {band}", "{band} a disparu", "wo ist {band} geblieben", "dónde están {band}", "{band} ya no aparece", "bonjour, rien ne se lance", "gracias, igual que antes", "danke, läuft", "merci, c'est bon", "Guten Morgen zusammen", "Buenos días", "Bonne journée", "Feliz Navidad", "Schöne Grüße aus {place}", "un saludo desde {place}", "wohin ist {song} verschwunden",
    "the Friday mix is late", "Android {d2} on a Pixel", "iOS {d2}.{d1}", "Bluetooth and Windows again", "the Summer Deal", "they reset my PIN", "the page only says OK", "Well done team", "Halloween songs in May", "edit: typo", "(edited)", "Dear team,", "Hey there,", "Hi all,", "Hello support,", "Dear Sir or Madam,", "Hey!", "this is wrong", "this is slow", "I'm stuck", "I'm lost", "ask for a refund", "under Settings", "I'm Premium since 2015", "This is Big", "Good Morning", "Happy Monday", "Customer Care Team", "Your Support Team", "Best Regards", "Kind regards, the team",
    "Thanks Team", "Sorry Guys", "Hi Folks,", "Dear Customer,", "Dear Listener,", "Hello World", "Sehr geehrte Damen und Herren,", "Liebes Team,", "Hola equipo,", "Chère équipe,", "the Song of the Year", "my Smart TV", "a Family Plan", "the Premium Duo", "Terms and Conditions", "Black Friday", "New York Times podcast", "Los Angeles time", "Google and Apple", "I spoke to the manager yesterday", "I spoke to Support", "my friend told me", "the holder is gone", "name of the song", "account holder", "call it a day", "{d2} people here", "asked for Windows",
]

_STREETS = "Old Mill Harrow Foxglove Saltmarsh Quarrel Cinder Juniper Maple Hollow Rose Garden Station Church Park Victoria Queen King Green Bridge River Castle Orchard Meadow Chestnut Willow High Ferry Ember".split()
_TYPES = "Street Road Lane Close Drive Avenue Terrace Way Hill Court Row Place Square Crescent Grove Gardens Boulevard Blvd St Rd Ave Ln Dr St. Rd. Ave.".split()
_DE = "Gerber Bahnhof Schiller Haupt Garten Linden Kirch Markt Berg Mühlen Goethe Ring Hof Brücken Rosen".split()
_DE_T = "straße strasse str. gasse weg allee platz".split()
_FR = ["rue des Tilleuls", "impasse Corneille", "avenue du Vieux Moulin", "rue de la Gare", "boulevard Victor", "place du Marché", "chemin des Vignes", "rue Pasteur", "quai du Port", "allée des Roses"]
_ES = ["Calle del Farol", "Plaza Mirador", "Avenida de la Paz", "Calle Mayor", "Camino Real", "Paseo del Río", "Plaza de España", "Calle San Juan", "Ronda Norte", "Travesía del Pozo", "Avda. de la Luz", "C/ Mayor", "C/ Nueva", "Avda. los Pinos", "Rua das Oliveiras", "Rua do Sol", "Travessa da Fonte", "Praça da Figueira", "Via Garibaldi", "Via dei Mulini", "Viale Roma", "Piazza Dante", "Keizersgracht", "Lange Straat", "ulica Lipowa", "Storgatan", "Largo do Rato"]
_TOWNS = _PLACES + "Leeds Graz Lyon Malmo Springfield Riverton Bremen Sevilla Lille Norfolk Dayton Kiel".split()
_HOSTS = "mailbox.example post.test inbox.mail.example uni.town.example webmail.example.org letters.invalid mail.example.com box.test gmx.example kite-mail.example.com".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def made_up(r: random.Random, least: int = 2, most: int = 4) -> str:
    """A word of two to four syllables with a capital."""
    return "".join(r.choice(_ON) + r.choice(_MID) + (r.choice(_OFF) if r.random() < 0.5 else "") for _ in range(r.randint(least, most))).capitalize()


def surname(r: random.Random) -> str:
    pick = r.random()
    return r.choice(_PLAIN_SUR) if pick < 0.25 else made_up(r) if pick < 0.55 else r.choice(_SUR_A) + r.choice(_SUR_B)


def given_name(r: random.Random) -> str:
    return made_up(r, 1, 4) if r.random() < 0.5 else r.choice(GIVEN)


def person(r: random.Random) -> str:
    given, last, pick = given_name(r), surname(r), r.random()
    if pick < 0.38:
        name = given
    elif pick < 0.7:
        name = f"{given} {last}"
        if r.random() < 0.12:
            name = f"{given} {r.choice([made_up(r), surname(r), 'de', 'van der', 'al', 'dos', 'von'])} {last}"
    elif pick < 0.77:
        name = f"{given} {r.choice('ABCDEFGHJKLMNRSTVWZ')}. {last}"
    elif pick < 0.85:
        name = f"{r.choice('ABCDEFGHJKLMNRSTVWYZ')}. {last}"
    elif pick < 0.93:
        name = f"{r.choice(['Mr', 'Ms', 'Mrs', 'Dr', 'Frau', 'Herr', 'Señor', 'Señora', 'Mr.', 'Dr.', 'Madame', 'Mme'])} {last}"
    else:
        name = f"{given} {last}-{surname(r)}" if pick > 0.97 else f"{last}, {given}"
    style = r.random()
    return name.lower() if style < 0.15 else name.upper() if style < 0.22 else name


def email(r: random.Random) -> str:
    given, last = r.choice(GIVEN).lower(), surname(r).lower().replace("ö", "o")
    user = r.choice([f"{given}.{last}", f"{given}{r.randint(60, 99)}", f"{given}{r.randint(1970, 2005)}", f"{given[0]}_{last}", f"{given}-{last}", f"{last}+music", f"{given}.{last[0]}.x", f"{given}{last}", f"{last}.{given}", f"info{r.randint(1, 99)}"])
    host, pick = r.choice(_HOSTS), r.random()
    if pick < 0.66:
        out = f"{user}@{host}"
    elif pick < 0.76:
        out = f"{user} @ {host}"
    elif pick < 0.86:
        out = f"{user} {r.choice(['AT', 'at', '(at)', '[at]', 'arroba'])} {host.replace('.', r.choice([' dot ', '[dot]', ' DOT ', '(dot)', ' punto ']))}"
    else:
        out = f"{user}{r.choice(['(at)', '[at]', '_at_'])}{host.replace('.', r.choice(['[dot]', '(dot)', '.']))}"
    return out.upper() if r.random() < 0.08 else out


def phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    area = r.choice(["212", "617", "702", "808", "916", "415", "303", "512"])
    base = r.choice(
        [f"+1-{area}-555-{d(4)}", f"({area}) 555-{d(4)}", f"{area}.555.{d(4)}", f"{area} 555 {d(4)}", f"{area}-555-{d(4)}", f"{area}555{d(4)}", f"+1 {area} 555 {d(4)}", f"030 {d(5)}-{d(3)}", f"030/{d(8)}", f"0{d(2)}/{d(7)}", f"0{d(2)}/{d(8)}", f"{area}{d(7)}", f"0{d(3)} {d(6)}", f"+49 (0)30 {d(5)} {d(3)}", f"+49 30 {d(7)}", f"0{d(3)}/{d(6)}",
         f"+447700{d(6)}", f"+44 7700 {d(3)} {d(3)}", f"0044 7700 {d(6)}", f"07700 {d(6)}", f"07700{d(6)}", f"(0)7700-{d(3)}-{d(3)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}", f"+{d(11)}", f"+44(0)20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"+254 {d(3)} {d(6)}", f"+55 11 9{d(4)}-{d(4)}", f"({d(2)}) 9{d(4)}-{d(4)}", f"+91 {d(5)} {d(5)}", f"{d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(4)} {d(4)}", f"00{d(2)} {d(2)} {d(3)} {d(4)}"]
    )
    return base + (r.choice([" ext. ", " x", " ext "]) + d(2) if r.random() < 0.12 else "")


def id_number(r: random.Random) -> tuple[str, str]:
    d, up = lambda n: _digits(r, n), lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))
    kind = r.choice(list(ID_CARRIERS))
    value = {
        "ssn": lambda: r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"9{d(8)}", f"9{d(8)}", f"{d(9)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}.{d(2)}.{d(4)}"]),
        "nino": lambda: r.choice([f"QQ{d(6)}C", f"qq {d(2)} {d(2)} {d(2)} c", f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(6)}{up(1)}"]),
        "tax": lambda: r.choice([f"0{d(1)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"]),
        "passport": lambda: r.choice([f"{up(1)}{d(7)}", f"{up(1)}{d(7)}{up(1)}", f"{up(1)}{d(2)}{up(1)}{d(5)}", f"{up(2)}{d(7)}", f"{d(9)}", f"{up(1)} {d(7)}"]),
        "licence": lambda: r.choice([f"{up(1)}{d(3)}-{d(4)}-{d(4)}", f"{d(11)}", f"{d(3)} {d(4)} {d(4)}", f"{up(5)}{d(6)}{up(2)}", f"{up(1)}{d(7)}", f"{up(1)}{d(12)}"]),
        "national": lambda: r.choice([f"0{d(10)}", f"{d(8)}{up(1)}", f"{d(8)} {up(1)}", f"{d(8)}-{up(1)}", f"X{d(7)}{up(1)}", f"{d(11)}", f"{up(1)}{d(2)}{up(1)}{d(5)}", f"{d(6)}-{d(4)}"]),
    }[kind]()
    return r.choice(ID_CARRIERS[kind]), value


def address(r: random.Random) -> str:
    n, pick = str(r.randint(1, 420)), r.random()
    town = r.choice(_TOWNS)
    code = r.choice([f" {_digits(r, 5)}", "", "", " NW9 0ZA", f" {_digits(r, 5)}", " AB1 2CD"])
    if pick < 0.42:
        name = " ".join(r.sample(_STREETS, r.choice([1, 1, 2])))
        if r.random() < 0.12:
            name = f"St. {r.choice(['Odo', 'John', 'Mary'])}'s"
        if r.random() < 0.08:
            name = f"{r.choice('NSEW')} {name}"
        out = f"{r.choice(['', '', '', 'Flat 3, ', 'Apt 4B, '])}{n} {name} {r.choice(_TYPES)}{r.choice(['', '', ', unit 12', ', Apt 4B', ', flat 2'])}"
    elif pick < 0.57:
        out = f"{r.choice([r.choice(_DE) + r.choice(_DE_T)] * 4 + ['Am Alten Markt', 'Am Bach', 'An der Mühle', 'Zum Hafen'])} {n}{r.choice(['', '', ' b', 'a'])}"
        code, town = "", f"{_digits(r, 5)} {town}"
    elif pick < 0.72:
        out = f"{n}{r.choice([' ', ', ', ' bis ', ' ter '])}{r.choice(_FR)}"
    elif pick < 0.85:
        out = f"{r.choice(_ES)}{r.choice([' ', ', '])}{n}{r.choice(['', ', bajo', ', 2º B', ', 3 izq'])}"
    else:
        out = f"{r.choice(['PO Box', 'P.O. Box', 'Postfach', 'Apartado', 'BP', 'Apartado de correos', 'PO box', 'Post office box'])} {r.randint(10, 4000)}"
    if r.random() < 0.75:
        out = f"{out}, {town}{code}"
    style = r.random()
    return out.lower() if style < 0.14 else out.upper() if style < 0.19 else out


def _plain(r: random.Random) -> str:
    out = r.choice(PLAIN)
    while "{band}" in out:
        out = out.replace("{band}", f"{r.choice(['', '', 'The '])}{r.choice(_ADJ)} {r.choice(_NOUN)}" if r.random() < 0.8 else f"{r.choice(_NOUN)} of {r.choice(_ADJ)} {r.choice(_NOUN)}", 1)
    while "{song}" in out:
        out = out.replace("{song}", r.choice(_SONG), 1)
    while "{place}" in out:
        out = out.replace("{place}", r.choice(_PLACES) if r.random() < 0.75 else made_up(r), 1)
    for n in range(1, 13):
        while f"{{d{n}}}" in out:
            out = out.replace(f"{{d{n}}}", _digits(r, n), 1)
    style = r.random()
    return out.upper() if style < 0.06 else out.lower() if style < 0.1 else out


def labelled(sentences: int, seed: int = 7) -> list[list[tuple[str, str | None]]]:
    """Texts as lists of (piece, kind); kind None is ordinary text."""
    r = random.Random(seed)
    makers = {"email": email, "phone": phone, "address": address, "person_name": person}
    out = []
    for _ in range(sentences):
        pieces: list[tuple[str, str | None]] = []
        parts: list[list[tuple[str, str | None]]] = [[(_plain(r), None)] for _ in range(r.choice([0, 1, 1, 2, 3]))]
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            kind = r.choice(KINDS + ("phone", "address") + ("person_name",) * 3)
            if kind == "id_number":
                carrier, value = id_number(r)
            else:
                carrier, value = r.choice(CARRIERS[kind]), makers[kind](r)
            left, right = carrier.split("{}")
            second = next((k for k in makers if f"{{{k}}}" in right), None)
            if r.random() < 0.1:
                left = left.lower() if r.random() < 0.7 else left.upper()
            if second:
                tail = right.split(f"{{{second}}}")
                parts.insert(r.randint(0, len(parts)), [(left, None), (value, kind), (tail[0], None), (makers[second](r), second), (tail[1], None)])
            else:
                parts.insert(r.randint(0, len(parts)), [(left, None), (value, kind), (right, None)])
        if not parts:
            parts = [[(_plain(r), None)]]
        for i, p in enumerate(parts):
            if i:
                pieces.append((r.choice([". ", ", ", "; ", " - ", "\n", " ", " ", "! ", "? "]), None))
            pieces.extend(p)
        if r.random() < 0.3:
            pieces.append((r.choice([" lol", "!", "?", " Thanks", " ...", " /KD", " ^AW", " 🙏", "\t", " (edited)"]), None))
        out.append([x for x in pieces if x[0]])
    return out
