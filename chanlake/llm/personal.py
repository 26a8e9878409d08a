"""Personal information in free text: found and replaced by typed placeholders.

A text with disguises is rewritten by transducers first: other widths, invisible characters, look-alike letters,
spelled digits, and "at" and "dot" in brackets or in words. Each character of the rewritten text knows the
span of source characters that it stands for, so what is found there is replaced in the source, and everything
else stays as it is, character by character.

Kinds: ``email``, ``phone``, ``id_number``, ``address`` (street with number) and ``person`` (surname with a first
name or a form of address). Kinds are looked for in the order email, address, id_number, phone, person; what
one kind has taken is not looked at again. Cheap tests decide which kinds a text can contain at all.

Defined results: null stays null and has no kinds, an empty text stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from . import languages, lookalikes

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# -- transducers --------------------------------------------------------------------------------------

# Names of the digits 0 to 9.
_DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zero um dois três quatro cinco seis sete oito nove",
        "zero uno due tre quattro cinque sei sette otto nove",
        "ноль один два три четыре пять шесть семь восемь девять",
        "нуль один два три чотири п'ять шість сім вісім дев'ять",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "meia": "6"}
_LETTERS = re.compile(r"[^\W\d_]+")
# Letters that re.I takes for others and str.lower() doesn't.
_TWINS = str.maketrans("ıſᲀᲁᲂᲃᲄᲅᲆᲇ", "isвдосттъѣ", "\u0307")
_TWIN = "ıſᲀᲁᲂᲃᲄᲅᲆᲇ\u0307"


class Words:
    """What the cheap tests before the patterns look at: the lower-case text and its runs of letters.

    A test may only fail where its pattern can't match. Patterns with apostrophes or hyphens are known by a run of
    letters between these (``needed``); patterns that may start or end inside a word are looked for in the text.
    """

    __slots__ = ("text", "runs")

    def __init__(self, text: str):
        self.text = text.lower()
        if not text.isascii() and any(c in self.text for c in _TWIN):
            self.text = self.text.translate(_TWINS)
        self.runs = set(_LETTERS.findall(self.text))

    def some(self, words: frozenset[str]) -> bool:
        return not self.runs.isdisjoint(words)

    def many(self, words: frozenset[str], n: int) -> bool:
        return self.some(words) and sum(w in words for w in _LETTERS.findall(self.text)) >= n

    def parts(self, starts: tuple[str, ...], ends: tuple[str, ...]) -> bool:
        return any(w.endswith(ends) or w.startswith(starts) for w in self.runs)

    def holds(self, stems: Sequence[str]) -> bool:
        return any(x in self.text for x in stems)


def needed(words: Sequence[str]) -> frozenset[str]:
    """The longest run of letters of each word."""
    return frozenset(max(_LETTERS.findall(w.lower()), key=len) for w in words)


_DIGIT_WORDS = needed(list(_DIGITS))
_D = "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_D})(?:[ ,\-]+(?:{_D})){{5,}}(?!\w)", re.I)
_SPELLED_ONE = re.compile(rf"(?:{_D})", re.I)
_AT = "at|ät|arroba|chiocciola|arobase|собака|собачка|равлик"
_DOT = "dot|punto|ponto|point|punkt|точка|крапка"
_BRACKET_AT = re.compile(rf"\s*[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]\s*", re.I)
_BRACKET_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*", re.I)
_WORD_AT = re.compile(rf"(?<=[\w]) (?:{_AT}) ([\w-]+)((?: (?:{_DOT}) [A-Za-z][\w-]*)+)", re.I)
_SPACED_AT = re.compile(r"(?<=[\w]) ?@ ([\w-]+)((?: ?\. ?[a-z][\w-]*| ?\. ?[A-Z]{2,}(?![a-z]))+)")
_ODD = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿  -  　＀-￯Ͱ-Ͽ]|[A-Za-z][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-z]")
_HINT = re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|[@.])\s*[\])}}>]|@ | (?:{_AT}) [\w-]+ (?:{_DOT}) ", re.I)


class Tape:
    """A rewritten text and, for each of its characters, the span of source characters."""

    __slots__ = ("text", "begin", "end")

    def __init__(self, text: str, begin: Sequence[int], end: Sequence[int]):
        self.text, self.begin, self.end = text, begin, end

    @classmethod
    def of(cls, source: str) -> Tape:
        return cls(source, range(len(source)), range(1, len(source) + 1))

    def characters(self) -> Tape:
        """Widths, invisible characters and spaces; look-alike letters inside words of two alphabets."""
        out, b, e = [], [], []
        for c, x, y in zip(self.text, self.begin, self.end):
            new = lookalikes._PLAIN.get(ord(c), c)
            if new is None:
                if e:
                    e[-1] = y
                continue
            for n in new:
                out.append(n)
                b.append(x)
                e.append(y)
        text = "".join(out)
        fixed = lookalikes._WORD.sub(lambda m: _one_alphabet(m[0]), text)
        return Tape(fixed if len(fixed) == len(text) else text, b, e)

    def replace(self, pattern: re.Pattern, new) -> Tape:
        out, b, e, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if m.end() == m.start():
                continue
            out.append(self.text[at : m.start()])
            b += self.begin[at : m.start()]
            e += self.end[at : m.start()]
            s = new if isinstance(new, str) else new(m)
            out.append(s)
            b += [self.begin[m.start()]] * len(s)
            e += [self.end[m.end() - 1]] * len(s)
            at = m.end()
        if not at:
            return self
        out.append(self.text[at:])
        b += self.begin[at:]
        e += self.end[at:]
        return Tape("".join(out), b, e)


def _one_alphabet(word: str) -> str:
    if not lookalikes._OTHER.search(word) or not re.search("[A-Za-z]", word):
        return word
    return lookalikes.form(word)


def tape(text: str, words: Words | None = None) -> Tape:
    """``words``: those of the text, if the caller has them."""
    t = Tape.of(text)
    if _ODD.search(text):
        t = t.characters()
    if _HINT.search(t.text):
        t = t.replace(_BRACKET_AT, "@").replace(_BRACKET_DOT, ".")
        t = t.replace(_WORD_AT, lambda m: f"@{m[1]}" + re.sub(rf" (?:{_DOT}) ", ".", m[2], flags=re.I))
        t = t.replace(_SPACED_AT, lambda m: f"@{m[1]}" + m[2].replace(" ", ""))
    if words is None or t.text is not text:
        words = Words(t.text)
    if words.many(_DIGIT_WORDS, 6):
        t = t.replace(_SPELLED, lambda m: "".join(_DIGITS[x[0].lower()] for x in _SPELLED_ONE.finditer(m[0])))
    return t


# -- identifiers --------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w@.+-])[\w][\w.+%'-]*@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}(?![\w@])|(?<![\w@.+-])[^\W\d_]@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}")
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁЇІЄҐ"
_NM = rf"[{_UP}][\w'’-]*"
_NO = r"\d{1,4}(?: ?[a-zA-Zа-я])?(?![\w.:,]*\d*:\d)(?!\w)"
_THEN = rf"(?: |(?<![{_UP}]))"  # a kind and a name in one word are told apart by the capital only
_STREET = (
    r"(?:Street|STREET|street|Str|St|ST|Road|ROAD|Rd|RD|Lane|LANE|Ln|Avenue|AVENUE|Ave|AVE|Drive|DRIVE|Dr|Court|COURT|Ct|Square|SQUARE|Sq|Terrace|TERRACE|Close|CLOSE|Crescent|CRESCENT|Boulevard|BOULEVARD|Blvd|Row|ROW|Way|WAY|Place|PLACE)\b\.?"
)
_ADDRESS = re.compile(
    "|".join(
        (
            # number before or after an English street
            rf"(?<![\w.:/-])\d{{1,5}}[A-Za-z]?,? (?:{_NM} ){{1,3}}{_STREET}(?:,? (?i:apt|flat|unit|suite|apartment)\.? ?\w+)?",
            rf"(?<!\w)(?:{_NM} ){{1,2}}(?:Street|STREET|Road|ROAD|Rd\.?|Lane|LANE|Avenue|AVENUE|Ave\.?|Boulevard|Square|Drive) {_NO}(?:,? (?i:apt|flat|unit|suite)\.? ?\w+)?",
            # street and number written together or apart, German
            rf"(?<!\w)[{_UP}][\w-]*(?:straße|strasse|STRASSE|STRAßE|str\.|gasse|GASSE|weg|platz|allee|damm|ufer|ring|steig) ?{_NO}",
            rf"(?<!\w)(?:{_NM} ){{1,2}}(?:Str\.|STR\.|Straße|Strasse|STRASSE|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer) ?{_NO}",
            # number, kind and name, French
            rf"(?<![\w.:/-])\d{{1,4}}(?: ?(?i:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd\.?|blvd\.?|place|chemin|impasse|quai|allée|route|cours|square|passage) (?:(?i:de la |du |des |de |d['’]|la |le |les )|(?i:de l['’]))?{_NM}",
            rf"(?<!\w)(?i:rue|boulevard|bd\.?) (?:(?i:de la |du |des |de ))?{_NM},? {_NO}",
            # kind, name and number: Spanish, Portuguese, Italian
            rf"(?<!\w)(?i:c/|calle|avda\.?|avenida|av\.|plaza|pl\.|paseo|carrer|camino|carretera|rua|praça|travessa|largo|estrada|alameda|via|viale|v\.le|piazza|corso|vicolo|strada){_THEN}(?:(?i:de la|de los|de las|della|delle|dei|del|dos|das|de|do|da|di) )?(?:{_NM} ?){{1,3}},? ?(?i:nº|n\.º|n°|núm\.?|n\.|numero|número)? ?{_NO}",
            # Cyrillic
            rf"(?<!\w)(?i:ул\.|улица|улице|пр\.|просп\.|пр-т|проспект|проспекте|переулок|переулке|пер\.|площадь|пл\.|наб\.|набережная|бульвар|б-р|бул\.|шоссе|проезд|вул\.|вулиця|вулиці|провулок|провулку|пров\.|площа){_THEN}(?:{_NM} ?){{1,3}},? ?(?i:д\.|дом|буд\.|будинок|б\.|№)? ?{_NO}(?:,? ?(?i:кв\.|корп\.|квартира) ?\w+)?",
            rf"(?<!\w)(?:{_NM} ){{1,2}}(?i:улица|проспект|переулок|бульвар|шоссе|вулиця|провулок),? ?(?i:д\.|дом|буд\.|будинок)? ?{_NO}",
        )
    )
)
_STREET_WORDS = frozenset(
    "street road rd lane ln avenue ave av boulevard blvd bd drive dr court ct square sq terrace crescent close row way place str st straße strasse gasse weg platz allee allée ring damm ufer rue chemin impasse quai route cours passage "
    "c calle avda avenida plaza pl paseo carrer camino carretera rua r praça travessa largo estrada alameda via viale v piazza corso vicolo strada "
    "ул улица улице пр просп проспект проспекте переулок переулке пер площадь наб набережная бульвар б бул шоссе проезд вул вулиця вулиці провулок провулку пров площа".split()
)
_STREET_ENDS = ("straße", "strasse", "gasse", "weg", "platz", "allee", "damm", "ufer", "ring", "steig", "str")
#: Kinds that may be written in one word with the name after them.
_STREET_STARTS = tuple(
    "calle avda avenida plaza paseo carrer camino carretera rua praça travessa largo estrada alameda via piazza corso vicolo strada "
    "улица улице проспект переулок переулке площа набережная бульвар шоссе проезд вулиця вулиці провулок провулку".split()
)
_STREETS = frozenset("street road lane avenue drive court square terrace close boulevard rd st ave blvd school schule hospital bridge brücke prize preis museum university festival station park hotel labs desk union watch club fc tower".split())

#: Words by which identity numbers in small letters are taken for such.
_ID_HINT = frozenset(
    "passport passports national id identity ssn social nino dni nie nif cpf ausweis ausweisnummer personalausweis personalausweisnummer reisepass reisepassnummer steuer steuerid sozialversicherung sozialversicherungsnummer identité passeport sécurité identità codice passaporto cartão bilhete passaporte pasaporte documento паспорт паспорта снилс инн удостоверение посвідчення рнокпп іпн".split()
)
#: One of these is in whatever _ID_WORD matches; the second are words of their own.
_ID_STEMS = tuple("passport national identity social ausweis reisepass steuer identité passeport sécurité identità codice passaport cartão bilhete pasaporte documento паспорт снилс удостоверение посвідчення".split()) + ("sozialversicherung",)
_ID_ALONE = frozenset("id ssn nino dni nie nif cpf инн рнокпп іпн".split())
_ID_WORD = re.compile(
    r"passport|national id|\bid (?:card|no|number)|identity|\bssn\b|social security|\bnino\b|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|ausweis|personalausweis|reisepass|steuer-?id|sozialversicherung|carte d['’]identité|passeport|sécurité sociale|"
    r"carta d['’]identità|codice fiscale|passaporto|cartão de cidadão|bilhete de identidade|passaporte|pasaporte|documento|паспорт|снилс|\bинн\b|удостоверение|посвідчення|\bрнокпп\b|\bіпн\b",
    re.I,
)
_ID = re.compile(
    r"(?<![\w@.#/-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|"  # two letters, six digits, letter
    r"[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|"  # letter, seven digits, letter; eight digits, letter
    r"\d{3}-\d{2}-\d{4}|9\d{2} \d{2} \d{4}|"  # 3-2-4
    r"[A-Z]\d{8,9}|"  # letter and eight or nine digits
    r"\d{2} \d{2} \d{6}|"  # 2-2-6
    r"\d{3}-\d{3}-\d{3} \d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|"  # 3-3-3-2
    r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|"
    r"[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}"
    r")(?![\w-]|\.\d)"
)
_ID_LOWER = re.compile(r"(?<![\w@.#/-])(?:[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]|[xyz]-?\d{7}-?[a-z]|\d{8}-?[a-z]|[a-z]\d{8,9})(?![\w-]|\.\d)")
_ID_AFTER = re.compile(r"\w*(?:[ -]?(?:no|nr|num|number|nummer|número|numéro|numero|номер|№|n°|nº|is|ist|:|\.|#))* ?:? ?((?=(?:[ -]?\w)*[ -]?\d{3})[A-Z]{0,3}[ -]?\d[\d -]{4,14}\d(?:[ -]?[A-Z])?)(?!\w)", re.I)

#: International account numbers: country, two check digits, up to 30 letters and digits in groups.
_ACCOUNT = re.compile(r"(?<![\w@.#/-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")


def _account(number: str) -> bool:
    """Whether the check digits are right: the number read with its head behind it leaves 1 when divided by 97."""
    n = number.replace(" ", "")
    return 15 <= len(n) <= 34 and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


_DIGIT = re.compile(r"\d")
#: As many digits as the shortest identity number has, but for a few separators; or the one that has letters between.
_MANY = re.compile(r"\d(?:[ .\-]?\d){5}|[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]")
_CLUSTER = re.compile(r"(?<![\w.+#@/-])\(?(?:\+|00)?\(?\d(?:[ .\-/()]{0,2}\d){6,14}(?!\d)")
_PHONE = re.compile(
    r"(?:"
    r"(?:\+|00)[1-9](?:[ .\-/()]{0,2}\d){7,13}|"  # international
    r"\(0\d{1,5}\)[ .\-/]?\d{3,}(?:[ .\-/]?\d+)*|"  # area code in brackets
    r"\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}|"
    r"0\d{1,4}/\d{3,}(?:[ .\-]?\d+)*|"  # area code before a slash
    r"07\d{9}(?!\d)|0[1-9]\d{9}(?!\d)|0[1-9](?:[ .\-]?\d{2}){4}(?!\d)|"  # pairs
    r"0[1-9]\d{2,4}[ .\-]\d{3,4}[ .\-]?\d{3,4}|07\d{9}|0[1-9]\d{8,9}|"
    r"8[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{2}|"
    r"[679]\d{2}(?: \d{3}){2}|[679]\d{2}(?: \d{2}){3}"
    r")"
)
_PHONE_WORD = re.compile(r"(?:\btel|phone|\bcall(?: me| us)?(?: at| on)?|mobile|whatsapp|signal|\bfon|telefon|handy|\bnummer|numéro|teléfono|móvil|telemóvel|telefone|cellulare|тел|номер|звон|дзвон)\w*\W{0,3}(?:(?:is|ist|es|est|é|è|le|il|el|o|no|nr)\W{1,2}){0,2}$", re.I)

# -- names --------------------------------------------------------------------------------------------

# Common first names.
_FIRST_LATIN = (
    "Adam Adrian Alan Alexander Alice Andrea Andreas Andrew Angela Anna Anne Anthony Arthur Barbara Ben Benjamin Brian Carol Caroline Charles Charlotte Christian Christine Christopher Clara Daniel David Deborah Dennis Diana Donald Dorothy Edward Edwin Elena Elizabeth Emily Emma Eric Eva Frank Gary George Grace Gregory Hannah Harold Helen Henry Jack James Jane Janet Jason Jennifer Jessica Joan John Jonathan Joseph Joshua Julia Julie Karen Kate Kenneth Kevin Laura Lauren Linda Lisa Lucy Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michelle Nancy Nicholas Nicole Nora Oliver Olivia Pamela Patricia Patrick Paul Peter Philip Rachel Rebecca Richard Robert Roger Ronald Rose Ruth Ryan Samuel Sandra Sarah Scott Sharon Simon Sophie Stephen Steven Susan Thomas Timothy Victor Victoria Virginia Walter William"
)
_FIRST_GERMAN_FRENCH = (
    "Anja Antje Bernd Bettina Birgit Brigitte Claudia Dieter Dirk Elke Erika Ernst Felix Florian Franz Friedrich Fritz Gabriele Gerhard Gisela Greta Günter Hans Heike Heinrich Heinz Helga Helmut Herbert Horst Ingrid Jan Jens Joachim Johann Johannes Jonas Jörg Jürgen Karin Karl Katharina Katja Klaus Kurt Lars Lena Lukas Manfred Markus Matthias Max Monika Otto Petra Rainer Ralf Renate Rolf Sabine Sebastian Silke Stefan Steffen Susanne Sven Thorsten Tobias Torsten Ulrich Ulrike Ursula Uwe Werner Wolfgang "
    "Adrien Agnès Alain Amélie André Antoine Aurélie Bastien Benoît Bernard Camille Catherine Cécile Céline Chantal Chloé Claire Claude Clément Corinne Denis Dominique Élise Élodie Émile Éric Étienne Fabien Florence Françoise François Gaëlle Gérard Guillaume Guy Hélène Henri Hugo Inès Isabelle Jacques Jean Jérôme Julien Laurent Léa Léo Louis Louise Luc Lucie Manon Marc Margaux Mathieu Maxime Michel Monique Nathalie Nicolas Odile Olivier Pascal Philippe Pierre Quentin René Romain Serge Sylvie Théo Thierry Valérie Véronique Vincent Yves Yvette"
)
_FIRST_SOUTHERN = (
    "Alberto Alejandro Alfonso Alicia Álvaro Ana Andrés Ángel Antonio Beatriz Begoña Carlos Carmen Carolina Concepción Cristina Diego Dolores Eduardo Elvira Emilio Enrique Esperanza Esteban Esther Eugenia Felipe Fernando Francisca Francisco Gabriel Gloria Gonzalo Guillermo Ignacio Inés Irene Isabel Iván Jaime Javier Jesús Joaquín Jorge José Josefa Juan Juana Lorena Lucía Luis Luisa Manuel Manuela Marcos Margarita Mariana Marina Mario Marta Mercedes Miguel Mónica Montserrat Natalia Nuria Óscar Pablo Paloma Paula Pedro Pilar Rafael Ramón Raquel Raúl Ricardo Roberto Rocío Rosa Rosario Rubén Salvador Santiago Sergio Silvia Sofía Susana Teresa Tomás Vicente "
    "Afonso Alexandre Amélia Bernardo Bruna Catarina Cláudia Duarte Fernanda Filipa Filipe Gonçalo Helena Henrique Inês Joana João Leonor Lourenço Luís Madalena Mafalda Margarida Matilde Nuno Paulo Rita Rodrigo Rui Tiago Vasco "
    "Alessandra Alessandro Alessia Angelo Bruno Carlo Caterina Chiara Claudio Dario Davide Domenico Elisa Enrico Fabio Federica Federico Filippo Francesca Francesco Franco Gianni Giacomo Giorgio Giovanna Giovanni Giulia Giuseppe Ilaria Laura Lorenzo Luca Lucia Marco Massimo Matteo Nicola Paola Paolo Pietro Riccardo Roberta Salvatore Sandro Sara Simona Simone Stefania Stefano Valentina Vincenzo"
)
_FIRST_CYRILLIC = (
    "Александр Александра Алексей Алёна Алла Анастасия Анатолий Андрей Анна Антон Артём Борис Вадим Валентина Валерий Вера Виктор Виктория Виталий Владимир Галина Григорий Дарья Денис Дмитрий Евгений Евгения Екатерина Елена Елизавета Иван Игорь Ирина Кирилл Ксения Лариса Леонид Любовь Людмила Максим Марина Мария Михаил Надежда Наталья Никита Николай Нина Олег Ольга Павел Пётр Петр Полина Роман Светлана Семён Сергей София Станислав Степан Татьяна Тимофей Фёдор Юлия Юрий Яна "
    "Андрій Богдан Валентин Василь Віктор Вікторія Віталій Володимир Галина Ганна Дмитро Євген Іван Ігор Ірина Катерина Ксенія Леся Лідія Любов Микола Михайло Надія Назар Наталія Оксана Олександр Олександра Олексій Олена Остап Павло Петро Роман Світлана Сергій Соломія Тарас Тетяна Юлія Юрій Ярослав"
)
FIRST = frozenset(w.lower() for part in (_FIRST_LATIN, _FIRST_GERMAN_FRENCH, _FIRST_SOUTHERN, _FIRST_CYRILLIC) for w in part.split())
# Forms of address.
_TITLES = (
    "Mr Mrs Ms Miss Mx Dr Prof Sir Dame Lady Lord Captain Capt Herr Herrn Frau Fräulein M Mme Mlle Monsieur Madame Mademoiselle Maître Sr Sra Srta Señor Señora Señorita Don Doña Dom Dona Senhor Senhora Doutor Doutora Sig Sigra Signor Signora Signorina Dott Dottoressa Avv Ing "
    "господин госпожа господина госпожи г-н г-жа гражданин гражданка доктор профессор товарищ пан пані пана панна добродій лікар професор"
)
TITLES = frozenset(_TITLES.lower().split())
_TITLE_HINT = needed(_TITLES.split())
_TITLE = "|".join(sorted(map(re.escape, _TITLES.split()), key=len, reverse=True))
#: What stands before a name that is not a person's.
_NOT_BEFORE = frozenset(
    "hotel hôtel storm hurricane sturm orkan tempête tormenta tempestade tempesta шторм буря ураган port puerto porto hafen порт saint st san santa santo sankt école schule school escuela escola scuola школа "
    "castle schloss château bar café restaurant ship schiff ferry yacht boat station bahnhof gare отель готель кафе пристань клиника клініка clinic street avenue calle via rue straße улица вулиця operation project projekt".split()
)
_CAP = rf"[{_UP}][\w'’]*[^\W\d_](?:-{_NM})?"
_TITLED = re.compile(rf"(?<![\w@#])(?:{_TITLE}|(?:MR|MRS|MS|DR|HERR|FRAU|MME|SR|SRA|SIG))(?:\.ra)?\.?,? (?:(?:{_CAP}|[{_UP}]\.) )?({_CAP})(?!\w)")
_PAIR = re.compile(rf"(?<![\w@#.])([^\W\d_][^\W\d_'’-]+)( (?:[{_UP}]\. ?|(?:van|von|de|da|di|del|della|dos|du|la|le) ){{0,2}})([^\W\d_][\w'’-]*[^\W\d_])(?!\w)")
_SURNAME_END = re.compile(
    r"(?:mann|sen|son|quist|ström|berg|stein|bauer|meier|maier|mayer|müller|schmidt|hoff|wald|bach|ez|az|iz|ow|ov|ev|ew|ski|sky|ska|cki|wicz|eux|eau|ard|elli|etti|ini|oni|ucci|ano|ello|ino|eira|ães|ques|ares|"
    r"ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|чук|щук|юк|як|ський|ська|цький|цька|ів|їв|ко|дзе|швили|ян)$"
)
_ASK = re.compile(
    rf"(?:(?i:my name is|signed by|\bask for|interview with|parcel for|letter for|regards,?|sincerely,?|ich heiße|mein name ist|paket für|rückfragen an|je m['’]appelle|colis pour|demandez|me llamo|mi nombre es|paquete para|preguntad por|pregunten por|chamo-me|o meu nome é|encomenda para|mi chiamo|il mio nome è|pacco per|chiedete di|меня зовут|посылка для|спросите|мене звати|посилка для|запитайте))[:,]? ({_CAP} (?:[{_UP}]\. )?{_CAP})(?!\w)"
)
#: One of these is in whatever _ASK matches; compounds end in them.
_ASK_HINT = tuple("name signed ask interview parcel letter regards sincerely heiße paket rückfragen appelle colis demandez llamo nombre paquete preguntad pregunten chamo nome encomenda chiamo pacco chiedete зовут посылка спросите звати посилка запитайте".split())


#: What people do: a name of two or three words with capitals before one of these is a person's.
_DOES = (
    "lives lived works worked said says wrote writes signed phoned told thinks was born studied married died wohnt wohnte arbeitet arbeitete sagt sagte schrieb schreibt meint wurde geboren studierte heiratete starb habite habitait travaille a dit dit a écrit écrit est né est née "
    "vive vivía trabaja dijo dice escribió nació estudió mora vivia trabalha disse diz escreveu nasceu abita abitava lavora ha detto dice ha scritto è nato è nata живёт живет жил жила работает сказал сказала пишет написал написала родился родилась мешкає живе працює сказав сказала пише написав написала народився народилась"
)
_DOES_TWO = frozenset({("was", "born"), ("wurde", "geboren"), ("a", "dit"), ("a", "écrit"), ("est", "né"), ("est", "née"), ("ha", "detto"), ("ha", "scritto"), ("è", "nato"), ("è", "nata")})
_DOES_ONE = frozenset(_DOES.split()) - {w for x in _DOES_TWO for w in x}
#: What is said before people: the same after one of these.
_TOLD = frozenset("contact dear tell call phone email met meet thank patient professor teacher nurse lawyer engineer liebe lieber patientin lehrer lehrerin contactez cher chère patiente querido querida paciente caro cara contatti gentile paziente дорогой дорогая пациент пациентка шановний шановна пацієнт пацієнтка".split())
_ABOUT = _DOES_ONE | _TOLD | {x[0] for x in _DOES_TWO}
_TWO = re.compile(rf"(?<![\w@#.])({_CAP}(?: (?:(?:van|von|de|da|di|del|bin|al|el) )?{_CAP}){{1,2}})(?!\w)")
_FOLLOWS = re.compile(r",? ([^\W\d_]+)(?: ([^\W\d_]+))?")
#: Words with capitals that name no person.
_NO_NAME = _STREETS | _NOT_BEFORE | frozenset(
    "the a an this that these those my your our his her its their group team mapping office university company department ministry committee council army city town village county north south east west new old great world national international royal central general "
    "bank house market church hall centre center press news times post radio tv agency institute foundation society association league party court government river lake mount mountain island bay cape valley sea ocean king queen saint labs inc ltd gmbh llc sa spa ooo "
    "die der das ein eine le la les un une el los las una il lo gli i o a os as um uma gruppe groupe grupo gruppo группа група nobody niemand personne nadie ninguém nessuno никто ніхто everyone somebody version thread".split()
) | frozenset(w for v in languages._FUNCTION.values() for w in v.split())
#: Before a place rather than a person.
_PLACED = frozenset("in from near at around of aus bei nach à depuis en desde a em da dal di в из у под з із біля до".split())


def _named(name: str) -> bool:
    return all(w.lower() not in _NO_NAME and w.lower() not in _COMMON and len(w) > 1 and not w.isupper() for w in name.split() if w[0].isupper())


def _persons(s: str, words: Words, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    if words.some(_TITLE_HINT):
        for m in _TITLED.finditer(s):
            if _free(m.span(), taken) and m[1].lower() not in _STREETS and _before(s, m.start()) not in _NOT_BEFORE:
                yield m.span()
    if words.some(FIRST):
        at = 0
        while m := _PAIR.search(s, at):
            at = m.start(3)
            a, b = m[1], m[3]
            fa, fb = a.lower() in FIRST, b.lower() in FIRST
            if not (fa or fb) or not _free(m.span(), taken):
                continue
            if fa and _surname(b, a) and _before(s, m.start()) not in _NOT_BEFORE and _STREETS.isdisjoint(_next(s, m.end())):
                yield m.span()
                at = m.end()
            elif fb and not fa and len(a) > 2 and a.isupper() and (b[0].isupper() and not b.isupper()) and not m[2].strip():
                yield m.span()
                at = m.end()
            elif fb and not fa and a[0].isupper() and s[m.end(1)] == "," and b[0].isupper():
                yield m.span()
    if words.some(_ABOUT):
        for m in _TWO.finditer(s):
            at, (x, y) = m.start(), m.span()
            first = m[1].split(" ", 1)[0]
            told = first.lower() in _TOLD
            if told:  # the word before the name has a capital itself
                x += len(first) + 1
            elif _before(s, at) in _TOLD:
                told = True
            name = s[x:y]
            if not told:
                f = _FOLLOWS.match(s, y)
                if not f or f[1] not in _DOES_ONE and (f[1], f[2]) not in _DOES_TWO or _before(s, at) in _PLACED:
                    continue
            if " " in name and _free((x, y), taken) and _named(name) and _before(s, x) not in _NOT_BEFORE and _STREETS.isdisjoint(_next(s, y)):
                yield x, y
    for m in _ASK.finditer(s) if words.holds(_ASK_HINT) else ():
        if _free(m.span(1), taken) and m[1].split()[0].lower() not in _NOT_BEFORE and m[1].split()[-1].lower() not in _STREETS:
            yield m.span(1)


def _surname(word: str, first: str) -> bool:
    if len(word) < 3 or word.lower() in _STREETS or word.lower() in _COMMON:
        return False
    if word[0].isupper() and first[0].isupper() and (first.isupper() or not word.isupper() or len(word) > 3):
        return not (first.isupper() and word.isupper()) or bool(_SURNAME_END.search(word.lower()))
    return not word[0].isupper() and first[0].islower() and bool(_SURNAME_END.search(word)) and len(word) > 5


# Words that follow a first name with a capital and are no surnames.
_COMMON = frozenset("the and und et y e i und der die das le la les el los il lo monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag street avenue road lane".split())


def _before(s: str, at: int) -> str:
    m = re.search(r"([^\W\d_]+)['’]?\W{0,2}$", s[max(0, at - 24) : at])
    return m[1].lower() if m and "." not in s[max(0, at - 2) : at] else ""


def _after(s: str, at: int) -> str:
    m = re.match(r" ([^\W\d_]+)", s[at : at + 24])
    return m[1].lower() if m else ""


def _next(s: str, at: int) -> list[str]:
    """The next word, and the one after it if the first has a capital."""
    m = re.match(rf" ([^\W\d_]+)(?:(?<=[\w]) ([^\W\d_]+))?", s[at : at + 40])
    return [w.lower() for w in (m[1], m[2] if m[1][0].isupper() else None) if w] if m else []


def _free(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    return all(span[1] <= a or span[0] >= b for a, b in taken)


def _found(s: str, words: Words) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def take(span: tuple[int, int], kind: str) -> None:
        if _free(span, taken):
            taken.append(span)
            out.append((*span, kind))

    if "@" in s:
        for m in _EMAIL.finditer(s):
            take(m.span(), "email")
    if _DIGIT.search(s):
        if words.some(_STREET_WORDS) or words.parts(_STREET_STARTS, _STREET_ENDS):
            for m in _ADDRESS.finditer(s):
                take(m.span(), "address")
        if _MANY.search(s):
            for m in _ID.finditer(s):
                take(m.span(), "id_number")
            for m in _ACCOUNT.finditer(s):
                if _account(m[0]):
                    take(m.span(), "id_number")
        announced = not words.runs.isdisjoint(_ID_HINT)
        if words.some(_ID_ALONE) or words.holds(_ID_STEMS):
            for w in _ID_WORD.finditer(s):
                announced = True
                if m := _ID_AFTER.match(s, w.end()):
                    take(m.span(1), "id_number")
        for m in _ID_LOWER.finditer(s) if announced else ():
            take(m.span(), "id_number")
        for c in _CLUSTER.finditer(s):
            at = c.start()
            m = _PHONE.match(s, at)
            if not m and s[at] != "(":
                m = _PHONE.match(s, at + (s[at] == "("))
            n = sum(x.isdigit() for x in m[0]) if m else 0
            if m and 8 <= n <= 15 and m.end() >= c.end() - 1 and not re.match(r"[.\-/]?\d", s[m.end() : m.end() + 2]):
                take(m.span(), "phone")
            elif _PHONE_WORD.search(s[max(0, at - 32) : at]) and 7 <= sum(x.isdigit() for x in c[0]) <= 15:
                take(c.span(), "phone")
    for span in _persons(s, words, taken):
        take(span, "person")
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Spans of the source text and their kinds, in order."""
    if not text:
        return []
    words = Words(text)
    t = tape(text, words)
    if t.text is not text:
        words = Words(t.text)
    out = [(t.begin[a], t.end[b - 1], k) for a, b, k in _found(t.text, words)]
    return sorted(out)


def redact(text: str | None) -> str | None:
    """The text with a typed placeholder in place of each span."""
    if not text:
        return text
    out, at = [], 0
    for a, b, k in find(text):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[k]]
            at = b
    return "".join([*out, text[at:]])


def detect(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, kind, begin, end): one row for each piece of personal data."""
    src = df.select(df[row_id].alias("id"), df[text].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for r in find(t):
                    at.append(k)
                    rows.append(r)
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(cols[2], pa.string()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32())], ["id", "kind", "begin", "end"])

    return src.mapInArrow(run, f"id {kind}, kind string, begin int, end int").withColumnRenamed("id", row_id)


def redacted(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, text) with placeholders."""
    src = df.select(df[row_id].alias("id"), df[text].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([redact(t) for t in b.column("text").to_pylist()], pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").toDF(row_id, text)
