"""Template residue, filler, error pages and demands for scripts in place of content.

Character n-gram models are fitted for filler, for error notices, for demands for scripts, for unfilled templates, and for natural
prose. The first four are fitted on the phrases below. That for prose is fitted on what isn't the corpus: on the pieces of public
tokenizers' vocabularies, weighted by their rank, and on the sentences below. So a text is never residue
for being unlike the others, nothing depends on the number of texts, and a rare domain is judged like a frequent one. A
placeholder of any notation counts as one character of its own. The likelihood ratio of the best
residue model against prose, by the longest n-gram that either has seen and smoothed over windows of ``WINDOW`` characters, tells which
stretches of a text are residue; a sentence is residue by the mean over its characters.

A document is excluded if residue covers at least ``COVERAGE`` of it, or ``REST`` of what follows one sentence of
prose at its beginning.

Defined results: null and empty texts have no residue and are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import ordinary

#: Characters of context, width of the smoothing window, share of residue that excludes a text.
ORDER, WINDOW, COVERAGE = 7, 24, 0.5
#: The same for what follows an opening sentence of prose, and the most characters of such an opening.
REST, OPENING = 0.7, 180
#: Bounds of the log ratio of a character, what a placeholder adds, and the mean above which a sentence is residue.
FLOOR, CEILING, PLACED, LIMIT = -3.0, 5.0, 3.0, 0.0
#: Characters of context from which an n-gram counts as seen, and the log ratio of a character without such.
KNOWN, UNKNOWN = 5, -1.0
#: Cells of a model's table; context and character are hashed into it.
CELLS = 1 << 20
#: How strongly the next shorter context counts in the models of residue and of prose.
SHORTER_RESIDUE, SHORTER_PROSE = 1.0, 3.0

_SLOT = "\ue000"
#: Notations of placeholders.
_PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{0,60}\}?\}\}|\$\{[^{}\n]{0,60}\}|\$\$[\w. ]{1,40}\$\$|@@[\w. ]{1,40}@@|%[A-Z][A-Z0-9_.]{1,40}%|%\d%|%\([\w ]{1,40}\)s|%%[\w.]{1,40}%%|<%[=-]?[^%\n]{0,60}%>|\[\[[^\[\]\n]{0,60}\]\]|"
    r"#\{[^{}\n]{0,60}\}|\{%[^%\n]{0,60}%\}|\{[a-z_][\w.]{0,40}\}|\{\d{1,2}\}|\[[\w ]{1,30} (?:here|goes here|hier|ici|aquí|aqui|qui|здесь|тут)\]|\[(?:INSERT|insert|Your|YOUR|your)[^\[\]\n]{0,40}\]|<(?:INSERT|insert|your|YOUR|placeholder)[^<>\n]{0,40}>|<[A-Z][A-Z0-9_.]{1,40}>|<\d>|\bundefined\b|\bnull\b|\bNaN\b|\bInvalid Date\b|__[A-Z][A-Z_]+__|\bT\.?B\.?[DAC]\b|\bXXX+\b|\bTODO\b|\bFIXME\b|_{4,}|\?{3,}"
)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")

_CODE = re.compile(r"\b[0-9a-f]{8,}\b")
_HOST = re.compile(r"https?://\S+|(?<![\w.-])[\w-]+(?:\.[\w-]+)*\.(?:example|invalid|test|com|org|net|io)\b")
_PATH = re.compile(r"(?<!\w)/[\w./-]{3,}")

_PHRASES = {
    "error": """The page you requested was not found. | We can't find the page you are looking for. | Page not found | This page doesn't exist. | This page may have been moved, renamed or deleted. | The link you followed may be broken. | Whoops, looks like something went wrong. | That page is gone. | An internal error occurred. Our engineers have been notified. | Our team has been informed. | We are working on it, please come back soon. | The site is down for maintenance and will be back shortly. | Temporarily unavailable due to maintenance. | This site can't be reached. | took too long to respond. | The server is overloaded. | The request could not be completed. | The request timed out. | Unable to connect to the database. | Error establishing a connection. | Your access has been blocked. | Your IP address has been banned. | This account has been suspended. | This video is unavailable. | This item is not available in your region. | Content not available. | You must be logged in to view this page. | Sign in to continue. | Invalid request. | Unknown error. | No results found. | Nothing here yet. | Exception in thread main | Stack trace | Segmentation fault | Parse error: syntax error, unexpected end of file | 404 Not Found | 403 Forbidden | 502 Bad Gateway | 500 Internal Server Error | 503 Service Unavailable | 504 Gateway Timeout | 401 Unauthorized | 429 Too Many Requests | 522 Connection timed out | 410 Gone | 400 Bad Request | 408 Request Timeout | Not Found (404) | Bad Gateway (502) | Internal Server Error (500) | Service Unavailable (503) | Error 404: not found | Error 500: internal server error | Error 502: bad gateway | Error 503: service unavailable | Error 504: gateway timeout | Error 403: forbidden | Error 401: unauthorized | Error 429: too many requests | Error 522: connection timed out | HTTP 404 | HTTP 403 | HTTP 500 | HTTP 502 | HTTP 503 | HTTP 429 | HTTP Error 500 | Oops! 404. | Oops! 503. | Oops, something went wrong. | Sorry, an error occurred. | An unexpected error has occurred. | Something went wrong while loading this page. Try again later. | Something went wrong while rendering the preview.
Please try again in 30 minutes. | Please try again later. | Try again in a few minutes. | Reference 4ab4d98af8ec | Request ID: 7f3a9c21 | Error code: 0x80070057 | The requested page could not be found. | The requested URL was not found on this server. | The requested resource could not be loaded. | The requested channel page could not be located on this server. | The page you are looking for does not exist. | You do not have permission to open this page. | You do not have permission to access this resource. | Access denied. | The server did not receive a valid reply from upstream. | edge-1 did not receive a valid response from upstream. | The preview of this page is not available. | This page is not available. | This content is currently unavailable. | This post was deleted or is no longer available. | Go back to the start page. | Return to the home page. | Back to homepage. | Contact support and quote this code. | Contact the administrator if the problem persists. | Home | Search | Help | nginx/1.18.0 | Apache/2.4.41 (Ubuntu) Server at example.com Port 80 | relaysrv/1.2 | cloudflare Ray ID: 6f2a | The connection timed out. | Connection refused. | The service is temporarily unavailable. | Maintenance in progress. | Your session has expired. Please log in again. | Database connection failed. | Fatal error: Uncaught exception in index.php on line 12 | Traceback (most recent call last): File main.py, line 3, in module | TypeError: cannot read property of undefined | NullPointerException at line 40 | Traceback: TemplateError in post_view line 4: value is None | Warning: undefined variable in page.php on line 8
Die angeforderte Seite existiert nicht. | Der Kanal wurde gelöscht. | Der Beitrag ist nicht mehr vorhanden. | L'article demandé n'existe pas. | Ce canal a été supprimé et n'existe plus. | La página solicitada no existe. | El canal ya no existe o fue eliminado. | A página pedida já não existe. | O canal foi removido. | La pagina richiesta non esiste. | Il canale non esiste più. | Запрошенная страница удалена. | Канал не существует. | Запитану сторінку видалено. | Каналу більше немає. | The requested channel could not be loaded. | The requested post does not exist any more.
Seite nicht gefunden. | Seite nicht gefunden | Zugriff verweigert | Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut. | Die Seite, die Sie suchen, wurde nicht gefunden. Zurück zur Startseite. | Die Seite wurde verschoben oder gelöscht. | Diese Website wird gerade gewartet. | Interner Serverfehler | La page que vous recherchez n'a pas été trouvée. | Cette page n'existe pas ou a été déplacée. Retour à l'accueil. | Le site est en maintenance. | La página que busca no se ha encontrado. | No se encontró la página. Volver al inicio. | El sitio está en mantenimiento. | A página que procura não foi encontrada. Voltar ao início. | O site está em manutenção. | La pagina che cerchi non è stata trovata. | La pagina non è disponibile o è stata rimossa. Torna alla home. | Il sito è in manutenzione. | Запрашиваемая страница не существует или была удалена. Вернуться на главную. | Сайт на техническом обслуживании. | Внутренняя ошибка сервера | Сторінка не існує або була видалена. Повернутися на головну. | Сайт на технічному обслуговуванні. | Page introuvable | Accès refusé | Une erreur est survenue. Veuillez réessayer plus tard. | Página no encontrada | Acceso denegado | Se ha producido un error. Inténtelo más tarde. | Página não encontrada | Acesso negado | Ocorreu um erro. Tente novamente mais tarde. | Pagina non trovata | Accesso negato | Si è verificato un errore. Riprova più tardi. | Страница не найдена | Доступ запрещён | Произошла ошибка. Попробуйте позже. | Сторінку не знайдено | Доступ заборонено | Сталася помилка. Спробуйте пізніше.""",
    "script": """JavaScript is required | Your browser does not support JavaScript. | Scripts are turned off in your browser. | This application works best with JavaScript turned on. | Switch on JavaScript to see this content. | noscript | content is loaded dynamically and cannot be shown. | Please allow cookies and try again. | We use cookies to improve your experience. Accept all cookies. | Please complete the security check to continue. | Automated access to this site is not allowed. | Checking if the site connection is secure. | This website is using a security service to protect itself from attacks. | You need to to enable JavaScript to run this app. | Please enable JavaScript to view this channel preview. | Please turn on JavaScript and reload the page. | Kindly activate JavaScript in your browser. | To continue, allow JavaScript in your browser. | Please enable JS to continue. | You need to allow JS and reload the page. | You need to turn on scripts in your browser to run this app. | Please allow client scripting in your browser. | Kindly turn on client scripting for this site. | Please activate scripts for this page. | This page requires JavaScript. Scripts appear to be blocked. | This site requires JavaScript and cookies. | Cookies and scripts must be allowed before the feed can load. | Please enable cookies. | Checking your browser before opening the page. This may take 5 seconds. | Checking your browser before accessing the site. | Please wait while we verify you are human. | Verify you are human by completing the action below. | Your browser is not supported. Please upgrade your browser. | JavaScript is disabled in your browser. | Enable JavaScript and cookies to continue. | Please disable your ad blocker. | Open in app | View in app | Download the app | channel preview | © channel preview | Loading, please wait | Just a moment...
Bitte aktivieren Sie JavaScript, um den Kanal anzuzeigen. | JavaScript muss aktiviert sein. | Veuillez activer JavaScript pour afficher ce canal. | JavaScript doit être activé. | Active JavaScript en su navegador para ver el canal. | Es necesario activar JavaScript. | Ative o JavaScript no seu navegador para ver o canal. | É necessário ativar o JavaScript. | Attiva JavaScript nel browser per vedere il canale. | È necessario attivare JavaScript. | Включите JavaScript, чтобы увидеть записи канала. | Для работы сайта нужен JavaScript. | Увімкніть JavaScript, щоб побачити дописи каналу. | Для роботи сайту потрібен JavaScript.""",
    "filler": """Aenean commodo ligula eget dolor. Cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus. Donec quam felis, ultricies nec, pellentesque eu, pretium quis, sem. Nulla consequat massa quis enim. | Vivamus elementum semper nisi. Phasellus viverra nulla ut metus varius laoreet. Quisque rutrum. Maecenas tempus, tellus eget condimentum rhoncus. Curabitur ullamcorper ultricies nisi. | This is an example page. | This is a sample post. Edit or delete it. | Your headline goes here. | Insert headline here | Insert your content here. | Subtitle goes here | Image caption | Type your text here | Description to be added | To be announced | More information will follow | Under development, check back later. | Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. | Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. | Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. | Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. | Magna aliqua elit sed lorem ipsum nostrud commodo veniam laboris. | Adipiscing labore ullamco nisi eiusmod incididunt tempor amet consectetur. | Commodo sit amet veniam elit nostrud ipsum aliqua labore magna. | Consectetur tempor laboris dolor commodo labore elit sed incididunt. | Sit nisi eiusmod amet consectetur incididunt magna elit laboris.
This is a placeholder paragraph. | It will be replaced before launch. | Replace this text with your own words. | Your channel description goes here. | Your text goes here. | Add your first post here. | Click to edit. | Click here to edit this text. | Sample text sample text sample text. | Placeholder text. | Dummy text for layout. | Insert text here. | Content coming soon. | Coming soon. | Under construction. | This page is intentionally left blank. | blah blah blah blah blah, more blah to fill the box | asdf asdf asdf qwer qwer | test test 123 test | foo bar baz foo bar | Hello world! This is your first post. | Welcome to your new site. | Just another site | Untitled document | New page | no content yet
Text folgt in Kürze. | Hier steht später der Inhalt. | Platzhaltertext. | Blindtext für das Layout. | Texte à venir, contenu provisoire pour la maquette. | Contenu à venir. | Texto de relleno. Próximamente más contenido. | Aquí irá el contenido. | Texto provisório. Conteúdo em breve. | Testo segnaposto. Contenuti in arrivo. | Здесь будет текст. Скоро появится содержание. | Тут буде текст. Незабаром з'явиться зміст.""",
    "template": """Hello ¤, your plan ends on ¤. | Dear ¤, welcome to ¤! | Hi ¤, thank you for joining ¤. | ¤ was founded in ¤ by ¤. | ¤ - ¤ (¤) | ¤ | ¤: ¤ forwarded ¤ messages to ¤ | Subject: ¤ | Lead: ¤ | Body: ¤ | About: ¤ | Contact: ¤ | Rules: ¤ | Posted by ¤ on ¤, views: ¤ | You have ¤ unread posts in ¤ and ¤ mentions. | Next meeting: ¤ at ¤, agenda ¤ | Join ¤ today and get ¤ stickers. | Title: ¤ | Date: ¤ | Author: ¤ | Price: ¤ | Click ¤ to unsubscribe from ¤. | Your order ¤ will arrive on ¤. | Kind regards, ¤ | Hallo ¤, hier ist die Ausgabe vom ¤. | Liebe ¤, willkommen bei ¤! | Bonjour ¤, votre canal ¤ compte ¤ abonnés. | Cher ¤, bienvenue à ¤! | Hola ¤, el canal ¤ tiene ¤ mensajes. | Olá ¤, o canal ¤ tem ¤ mensagens. | Ciao ¤, il canale ¤ ha ¤ messaggi. | Здравствуйте, ¤! Канал ¤, выпуск ¤. | Вітаємо, ¤! Канал ¤, випуск ¤.""",
}
# Natural prose of several kinds, for how words follow each other.
_PROSE = """It was late when we left the house and walked down to the river. The weather has been dry for most of the month, so farmers are worried about the harvest. He said that he would come back in the morning with the others. There is no reason to think that prices will fall before the end of the year. The company was founded in a small town and now employs more than two hundred people. If you want to learn the language, you should read every day and speak with people who know it. They had been friends since school, but she had not seen him for years. The book is about a man who loses his job and has to start again. Most of the patients recovered within two weeks, although some needed further treatment. In this chapter we look at how plants take up water from the soil.
The value is returned as a string, and an error is raised if the argument is not a number. You can change this setting in the options menu, where the default is shown. A server answers requests from many clients at the same time. When the page is loaded, the browser asks the server for the images that it needs. The error is caused by a missing file; to fix it, copy the file to the directory and start the program again. This means that the list is not copied, so changes to one are seen in the other. For example, the following code opens a file, reads it line by line and closes it. The message explains what went wrong and what the user can do about it. Scripts that run in the browser can't read files on the disk. The template has a field for the name of the customer, which is filled in when the letter is printed. Lorem ipsum is a text that designers use. Please send us the list of names before Friday, and let me know if anything is missing. Thank you for your help with the translation. The meeting will be held in the library at six. I don't know why the bus didn't stop, but we had to walk. Are you going to the market tomorrow? We found the page with the map that you sent us. The road to the harbour is closed because of the flood.
Es war schon spät, als wir das Haus verließen und zum Fluss hinuntergingen. Das Wetter ist seit Wochen trocken, deshalb sorgen sich die Bauern um die Ernte. Die meisten Menschen in der Stadt arbeiten in der Fabrik oder auf den Feldern. Er sagte, dass er am Morgen mit den anderen zurückkommen werde. Wenn man eine Sprache lernen will, sollte man jeden Tag lesen. Die Seite des Buches, auf der die Karte steht, fehlt. Der Server beantwortet die Anfragen vieler Nutzer. Bitte schickt uns die Liste bis Freitag.
Il était tard quand nous avons quitté la maison pour descendre vers la rivière. Le temps est sec depuis des semaines et les paysans s'inquiètent pour la récolte. La plupart des habitants de la ville travaillent à l'usine ou dans les champs. Il a dit qu'il reviendrait le matin avec les autres. Si l'on veut apprendre une langue, il faut lire tous les jours. Le serveur répond aux demandes de nombreux utilisateurs. Merci de nous envoyer la liste avant vendredi.
Era tarde cuando salimos de la casa y bajamos al río. El tiempo ha sido seco durante semanas y los campesinos están preocupados por la cosecha. La mayoría de la gente de la ciudad trabaja en la fábrica o en el campo. Dijo que volvería por la mañana con los demás. Si quieres aprender un idioma, tienes que leer todos los días. El servidor responde a las peticiones de muchos usuarios. Por favor, enviad la lista antes del viernes.
Era tarde quando saímos de casa e descemos até ao rio. O tempo tem estado seco há semanas e os agricultores estão preocupados com a colheita. A maior parte das pessoas da cidade trabalha na fábrica ou no campo. Ele disse que voltaria de manhã com os outros. Se queres aprender uma língua, tens de ler todos os dias. O servidor responde aos pedidos de muitos utilizadores. Por favor, enviem a lista até sexta-feira.
Era tardi quando uscimos di casa e scendemmo verso il fiume. Il tempo è secco da settimane e i contadini sono preoccupati per il raccolto. La maggior parte della gente della città lavora in fabbrica o nei campi. Disse che sarebbe tornato la mattina con gli altri. Se vuoi imparare una lingua, devi leggere ogni giorno. Il server risponde alle richieste di molti utenti. Per favore, mandateci la lista entro venerdì.
Было уже поздно, когда мы вышли из дома и пошли к реке. Погода стоит сухая уже несколько недель, и крестьяне беспокоятся об урожае. Большинство людей в городе работает на заводе или в поле. Он сказал, что вернётся утром вместе с другими. Если хочешь выучить язык, нужно читать каждый день. Сервер отвечает на запросы многих пользователей. Пришлите нам список до пятницы, пожалуйста. На этой странице описано, как работает программа.
Було вже пізно, коли ми вийшли з дому і пішли до річки. Погода стоїть суха вже кілька тижнів, і селяни турбуються про врожай. Більшість людей у місті працює на заводі або в полі. Він сказав, що повернеться вранці разом з іншими. Якщо хочеш вивчити мову, треба читати щодня. Сервер відповідає на запити багатьох користувачів. Надішліть нам список до п'ятниці, будь ласка. На цій сторінці описано, як працює програма."""
#: Times that a sentence of the prose above counts.
_PROSE_WEIGHT = 40.0
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


#: What a text must contain for a pattern to be tried at all.
_SLOT_HINTS = ("{", "[", "<", "$$", "@@", "%", "__", "???", "TBD", "TBA", "TBC", "T.B", "XXX", "TODO", "FIXME", "undefined", "null", "NaN", "Invalid Date")
_HOST_HINTS = ("://", ".example", ".invalid", ".test", ".com", ".org", ".net", ".io")


def prepared(text: str) -> str:
    """Placeholders as one character each, codes, paths and hosts shortened, tags dropped."""
    if any(x in text for x in _SLOT_HINTS):
        text = _PLACEHOLDER.sub(_SLOT, text)
        if "<" in text:
            text = _TAG.sub("", text)
    if any(x in text for x in _HOST_HINTS):
        text = _HOST.sub("/", text)
    if "/" in text:
        text = _PATH.sub("/", text)
    return _CODE.sub(_code, text)


def _code(m: re.Match) -> str:
    return m[0] if m[0].isalpha() or m[0].isdigit() else "0"


def _stacked(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of characters, digits as 0, with ``ORDER`` line breaks before each; begin and length of each."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    gap = "\n" * ORDER
    c = np.frombuffer((gap + gap.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 49) & (c <= 57)] = 48
    return c, np.cumsum(size + ORDER) - size, size


def _ngrams(c: np.ndarray, at: np.ndarray, ahead: bool = True) -> Iterator[np.ndarray]:
    """Cells of the n-grams that end at each place, from the single character to ``ORDER`` more before it; those of their contexts if not ``ahead``."""
    h = np.full(len(at), 0x51, np.uint64)
    if ahead:
        h = (h ^ c[at]) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ORDER + 1):
        if k:
            h = (h ^ c[at - k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield ((h >> np.uint64(7)) & np.uint64(CELLS - 1)).astype(np.int64)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class CharModel:
    """Character model: the counts of each order, interpolated with the next shorter context."""

    def __init__(self, texts: Sequence[str], weights: Sequence[float] | None = None, shorter: float = SHORTER_RESIDUE):
        c, begin, size = _stacked(texts)
        at = _places(begin, size)
        w = None if weights is None else np.repeat(np.asarray(weights, np.float64), size)
        self.joint = [np.bincount(x, w, minlength=CELLS).astype(np.float32) for x in _ngrams(c, at)]
        self.context = [np.bincount(x, w, minlength=CELLS).astype(np.float32) for x in _ngrams(c, at, False)]
        self.shorter = np.float32(shorter)

    def chances(self, c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Probability of the character at each place by each order."""
        p, out = np.full(len(at), 1 / 4000.0, np.float32), []
        for k, (x, y) in enumerate(zip(_ngrams(c, at), _ngrams(c, at, False))):
            p = (self.joint[k][x] + self.shorter * p) / (self.context[k][y] + self.shorter)
            out.append(p)
        return out


def _pieces(paths: Sequence[str]) -> tuple[list[str], list[float]]:
    """Pieces of vocabularies as words with the space after them, and weights that fall with their rank."""
    found = ordinary.pieces(paths)
    return [t + " " if len(t) > 3 else t for t, _ in found], [30_000 / (r + 300) for _, r in found]


@lru_cache(maxsize=4)
def fit(paths: tuple[str, ...] = ordinary.VOCABULARIES) -> Residue:
    """The model; it depends on the phrases, the prose and the vocabularies, not on any corpus."""
    groups = {}
    for k, v in _PHRASES.items():
        x = [re.sub(r"\d", "0", q.strip()).replace("¤", _SLOT) for q in re.split(r"\s\|\s|\n", v) if q.strip()]
        groups[k] = [*x, *(x[j] + " " + x[(j * 7 + 3) % len(x)] for j in range(len(x)))]
    latin = sorted({w for t in groups["filler"] if "ipsum" in t.lower() or "nisi" in t.lower() for w in re.findall(r"[a-z]+", t.lower())})
    groups["filler"] += [f"{a} {b} {a}, {b}." for j, a in enumerate(latin) for b in (latin[(j * 11 + 5) % len(latin)], latin[(j * 17 + 2) % len(latin)], latin[(j * 23 + 9) % len(latin)])]  # its words come in any order
    models = [CharModel(v) for v in groups.values()]
    words, weights = _pieces(paths)
    prose = sentences(_PROSE)
    natural = CharModel([*words, *prose], [*weights, *([_PROSE_WEIGHT] * len(prose))], SHORTER_PROSE)
    tables = np.full((ORDER + 1, CELLS), np.nan, np.float32)
    for texts in (words, prose, [t for v in groups.values() for t in v]):
        c, begin, size = _stacked(texts)
        at = _places(begin, size)
        bad, good = [m.chances(c, at) for m in models], natural.chances(c, at)
        for k, cell in enumerate(_ngrams(c, at)):
            tables[k][cell] = np.clip(np.log(np.maximum.reduce([b[k] for b in bad])) - np.log(good[k]), FLOOR, CEILING)
    return Residue(tables)


class Residue:
    """``tables``: for each order the log ratio of residue to prose by cell, NaN where neither was seen; ``limit``: the
    mean ratio above which a sentence is residue. This is all that is sent to the tasks, 32 MB."""

    def __init__(self, tables: np.ndarray, limit: float = LIMIT):
        self.tables, self.limit = tables, limit

    def ratios(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log ratio of residue to prose at each place, by the longest n-gram that was seen; unknown words speak against residue."""
        out = np.full(len(at), UNKNOWN, np.float32)
        for k, cell in enumerate(_ngrams(c, at)):
            if k >= KNOWN:
                r = self.tables[k][cell]
                np.copyto(out, r, where=r == r)
        return out

    def windows(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ratio smoothed over windows, for all characters of all sentences; begin and length of each sentence."""
        c, begin, size = _stacked(parts)
        at = _places(begin, size)
        r = np.zeros(len(c), np.float32)
        r[at] = self.ratios(c, at)
        r += PLACED * (c == ord(_SLOT))
        total = np.r_[0, np.cumsum(r, dtype=np.float64)]
        # a window ends where its sentence does
        lo, hi = np.maximum(at - WINDOW // 2, np.repeat(begin, size)), np.minimum(at + WINDOW // 2, np.repeat(begin + size, size))
        return (total[hi] - total[lo]) / (hi - lo), np.cumsum(size) - size, size

    def means(self, parts: Sequence[str]) -> np.ndarray:
        if not len(parts):
            return np.zeros(0)
        r, begin, size = self.windows(parts)
        total = np.r_[0, np.cumsum(r)]
        return (total[begin + size] - total[begin]) / np.maximum(size, 1)

    def judge(self, texts: Sequence[str | None]) -> list[tuple[float, bool]]:
        """For each text its share of residue, and whether it is to be excluded."""
        lists = [sentences(prepared(t)) if t else [] for t in texts]
        mean = self.means([s for x in lists for s in x])
        out, at = [], 0
        for x in lists:
            bad = mean[at : at + len(x)] > self.limit
            size = np.array([len(s) for s in x], np.float64)
            at += len(x)
            if not len(x):
                out.append((0.0, False))
                continue
            share = float((bad * size).sum() / size.sum())
            rest = share
            k = 0
            while k < len(x) - 1 and not bad[k] and (k == 0 or size[: k + 1].sum() <= OPENING):
                k += 1
            if k:
                rest = float((bad[k:] * size[k:]).sum() / size[k:].sum())
            out.append((share, share >= COVERAGE or rest >= REST))
        return out


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, _SENTENCE.split(text)) if s]


def judged(df: DataFrame, model: Residue, row_id: str, text: str) -> DataFrame:
    """(id, share, excluded) for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(df[row_id].alias("id"), df[text].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = m.judge(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.bool_())], ["id", "share", "excluded"])

    return src.mapInArrow(run, f"id {kind}, share double, excluded boolean").toDF(row_id, "share", "excluded")
