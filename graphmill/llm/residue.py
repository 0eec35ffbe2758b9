"""Template residue, filler, error pages and script notices that stand where content should be.

Labelled exemplars, residue and legitimate, are kept in an inverted index: term
-> exemplars. A term is a concept (all ways of asking to switch something on, in
several languages, are one term), the mark of a placeholder, of a status code or
of endless repetition, or else a word's stem; so an exemplar stands for a
pattern and not for one wording. Texts are cut into passages; what a text only
shows or quotes (code, inline code, quotations, tables, log and program lines)
is taken out first. Windows of consecutive passages retrieve the exemplars that
share one of their weightiest terms, and are compared by TF-IDF containment: the
share of the exemplar's weight that the window holds, and the share of the
window's weight that the label's exemplars cover together. A window that residue
matches well, and better than anything legitimate does, makes the text a case.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from http import HTTPStatus
from itertools import groupby

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT, STATUS, REPEAT = "<slot>", "<status>", "<repeat>"

#: The words and phrases of each concept; a star stands for any ending.
CONCEPTS = {
    "script": "javascript* | java script* | script | scripts | scripting | client-side script* | client side script* | active content | js | skript*",
    "enable": "enabl* | activate* | activating | allow | allowing | permit | permitting | turn on | switch on | turned on | switched on | unblock* | aktivier* | einschalten | erlauben | zulassen | activer | activez | autoris* | activar | activa | active | habilit* | permita | permite",
    "disabled": "disabled | turned off | switched off | blocked | blocking | blocker | blocks | is off | are off | deaktiviert | ausgeschaltet | désactivé* | bloqué* | desactivad* | bloquead*",
    "need": "need | needs | needed | require | requires | required | requiring | must | depends on | relies on | benötig* | braucht | brauchen | erforder* | notwendig | a besoin | besoin de | nécessit* | requis* | requiert | exige | necesit* | requier* | necesari*",
    "without": "without | ohne | sans | sin",
    "cannot": "cannot | can't | can not | couldn't | could not | won't | will not | doesn't | does not | don't | do not | unable to | isn't | not able | fail to | kann nicht | können nicht | kein | keine | ne peut | ne peuvent | aucun | aucune | n'est | no puede* | no se | ningún | ninguna",
    "view": "view | viewing | see | show | shown | display | displayed | displays | read | open | opens | load | loads | loaded | run | runs | work | works | working | use | using | function | functions | render | rendered | continue | proceed | access | visible | zugriff | accès | acceso | anzuzeigen | anzeigen | angezeigt | sehen | nutzen | funktionier* | verfügbar | afficher | affiché* | voir | utiliser | fonctionn* | lire | mostrar | muestra | muestran | ver | usar | funcionar | funciona | leer",
    "browser": "browser | browsers | navigateur | navegador",
    "reload": "reload | refresh | restart | neu laden | actualis* | rechargez | recharger | recargue | recargar | actualice",
    "polite": "please | bitte | veuillez | por favor | merci | gracias | kindly",
    "sorry": "sorry | oops | whoops | apolog* | unfortunately | leider | désolé* | lo siento | perdón | entschuldig*",
    "again": "try again | again | retry | check back | come back | be back | slow down | try later | versuchen | erneut | réessay* | inténtelo | intente | vuelva",
    "soon": "later | soon | shortly | moment | momentarily | minute | minutes | hour | hours | right now | at this time | currently | temporarily | später | gleich | plus tard | bientôt | más tarde | pronto | momentan | derzeit | actuellement | vorübergehend | temporairement | temporalmente",
    "missing": "not found | couldn't find | could not find | cannot find | can't find | could not be found | cannot be found | can't be found | can't locate | doesn't exist | does not exist | no longer exists | nicht gefunden | existiert nicht | existiert nicht mehr | introuvable | n'existe pas | n'existe plus | no encontrad* | no existe | ya no existe | no longer available | no longer here | not available",
    "gone": "gone | removed | moved | deleted | withdrawn | entfernt | gelöscht | verschoben | supprimé* | déplacé* | eliminad* | movid*",
    "down": "unavailable | down | offline | maintenance | outage | out of service | nicht erreichbar | wartung* | indisponible | hors ligne | no disponible | mantenimiento | fuera de servicio",
    "busy": "overload* | busy | too many | rate limit* | rate-limit* | heavy load | heavy traffic | high demand | high traffic | at capacity | quota | throttl* | überlastet | ausgelastet | surchargé* | sobrecargad* | demasiad*",
    "denied": "denied | forbidden | unauthori* | not authori* | not allowed | permission* | restricted | not permitted | verweigert | verboten | refusé* | interdit* | denegad* | prohibid*",
    "login": "sign in | log in | signed in | logged in | login | sign-in | log-in | anmeld* | melden sie sich | einloggen | connecter | connectez | se connecter | identifi* | inicie sesión | iniciar sesión",
    "happen": "occurred | occurs | happened | aufgetreten | survenu* | se produjo | ocurri*",
    "wrong": "went wrong | wrong | error | errors | failed | failure | fehler | fehlgeschlagen | erreur* | échou* | échec | fallo | falló | erróne*",
    "internal": "internal | interner | interne | interno | unexpected | unerwarteter | inattendu* | inesperad*",
    "timeout": "timeout | timed out | time-out | took too long | reset | disconnect* | refused | zeitüberschreitung | délai dépassé | tiempo de espera",
    "expired": "expired | invalid | abgelaufen | ungültig* | expiré* | invalide* | caducad* | expirad* | inválid*",
    "link": "link | url | address | adresse* | dirección | enlace | lien",
    "account": "session | account | sitzung | konto | compte | sesión | cuenta",
    "server": "server | servers | upstream | gateway | proxy | host | serveur* | servidor*",
    "connect": "connect | connection | connecting | verbindung | connexion | conexión",
    "requested": "requested | request id | angefordert* | demandé* | solicitad*",
    "visitor": "visitor | visitors | requests | users | traffic | besucher | visiteurs | visitantes",
    "wait": "wait | waiting | checking | check your | verify* | warten | patient* | espere | attendez | loading | cookies | cookie | human | captcha",
    "copy": "text | texte | texto | copy | content | contents | contenu | contenido | inhalt | blindtext | fülltext | faux texte | section | abschnitt | paragraph | absatz | heading | überschrift | titre | título | description | beschreibung",
    "dummy": "dummy | sample | placeholder | filler | blindtext | fülltext | platzhalter | faux texte | texte factice | relleno | de ejemplo | lorem ipsum | lipsum",
    "here": "here | hier | ici | aquí",
    "coming": "coming | comes | follows | goes | will be written | will be added | to be added | to be written | under construction | folgt | steht | à venir | próximamente | en construction | en construcción | im aufbau | tbd | insert | write your | type your | replace this | add your | add a",
    "layout": "layout | mockup | mock-up | maquette | maqueta | design only | maquetación",
    "template": "jinja* | mustache | handlebars | liquid | brace | braces | bracket | brackets | placeholder | placeholders | template | templates | templating | interpolat* | substitut* | syntax | renderer | expands | expanded | literal* | variable | variables | looked up | stands for | is replaced | are replaced | gets replaced | be replaced | replaces | replace | filled in | fills in | escaped | you write | write | wird ersetzt | platzhalter | est remplacé* | se reemplaza* | sustituy*",
    "talk": "say | says | said | note | notes | test | tests | log | logs | logged | handler | returns | answers | responds | gave | drop | drops | fixed | instead of | when | until | which | meaning | because | stops | treats | counts | retries",
}

#: The labelled exemplars. Subjects such as "the page" are left out; SLOT stands for any placeholder.
SCRIPT_NOTICES = """
You need to enable JavaScript to run this app.
Please enable JavaScript to view this page.
Please turn on JavaScript in your browser and reload.
Allow scripts to see this.
Switch on scripts and refresh.
Won't load unless you enable scripts.
JavaScript is required to view this site.
This page requires scripts.
JavaScript is disabled.
It does not load, as scripts are blocked.
Your browser does not support scripting, so the page cannot be displayed.
Sorry, this cannot be shown without scripting.
Sorry, but this doesn't work with JavaScript disabled.
It won't work, for script blocking is not off.
Please wait while we check your browser. Enable cookies and scripts to continue.
Loading, please wait; make sure that scripts are allowed.
If it takes too long, make sure script blocking is off.
Scripts are blocked in your browser; please allow them.
No content is shown without JavaScript.
Without scripts, nothing is visible.
Rendered in the browser: please permit scripts.
""".strip().splitlines()
ERROR_PAGES = """
Error 404
HTTP/1.1 503
status 500 request id
Error code 502
Error 404: page not found
503 unavailable
Something went wrong on our side. Please try again in a few minutes.
An internal error occurred. Try again later.
An error occurred, please retry.
An unexpected error happened; please come back later.
You have been rate limited. Slow down and retry later.
Too many requests. Try again soon.
The server is busy, come back in an hour.
Our servers are overloaded right now.
Too many visitors right now; the page will open in a moment.
High demand: too many users at this time.
It is private or was removed. Sign in to continue.
Access denied. Please sign in.
Please log in, you are not allowed to view this.
You don't have permission to view this page.
You are not authorized to access it.
Forbidden: you don't have permission to open this.
Your session has expired. Please log in again.
Session expired, sign in again.
Down for maintenance. We'll be back shortly.
The site is offline, check back soon.
Temporarily unavailable, check back soon.
The service is unavailable at this time, please retry later.
Sorry, it was not found. It may have been moved.
The requested page was not found on this server.
Page not found, it was moved or deleted.
Oops! That page can't be found.
The requested address does not exist.
The link does not exist.
This page is no longer available.
Sorry, not available.
Sorry, it took too long to answer.
The server took too long to respond.
Invalid or expired link.
This link is expired.
Unable to load the page: connection reset.
Could not connect: connection timeout.
Failed to fetch page (timeout).
The connection failed, it was reset.
upstream connect error or disconnect before headers, reset reason: timeout
Upstream error: disconnected from the server.
""".strip().splitlines()
FILLER = """
Your text goes here
Insert your content here
This section will be written soon.
Content follows soon.
Sample copy for layout only.
Dummy text for the layout.
Placeholder text.
This is filler text.
The text follows here later.
Text coming soon.
""".strip().splitlines()
#: The four sentences of the usual pseudo-Latin filler.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
""".strip().splitlines()
REPEATED = ("bla bla bla bla bla bla", "foo bar foo bar foo bar foo bar foo bar", "test test test test test test", "xxxx xxxx xxxx xxxx xxxx xxxx")
#: What stands for an unfilled placeholder: it, with whatever sentence around.
PLACEHOLDERS = ("Dear <slot>", "# <slot>", "the <slot> makes the <slot>", "about <slot> of them")
LEGITIMATE = """
The web view works without JavaScript; only the outline needs it, and we say so in a note.
Show a friendly note when scripts are blocked, instead of an empty page.
We drop pages that say "enable JavaScript" or "access denied" before they reach the index.
When the outline is missing, the handler answers 404 and the client retries 3 times.
Log of the smoke test: the request gave 503 twice, then 200.
The preview no longer shows the error page while the worker is warming up.
Tests feed the chunker with filler so that the stream has no symbol in it.
The service reports page not found under the old address until the index is rebuilt.
Unter der alten Adresse meldet der Dienst, dass die Seite nicht gefunden wurde, bis der Index neu gebaut ist.
Status codes and their meaning: 401 sign in first, 404 the page is gone.
The handler returns nothing when it has expired.
""".strip().splitlines()
#: Legitimate uses of placeholders: texts about templates.
ABOUT_SLOTS = ("a placeholder like <slot>", "<slot> is replaced", "you write <slot>", "replace <slot>")

#: Labels of what is no residue.
LEGAL = ("legitimate", "about placeholders")
#: Least containment, and least coverage by the label's exemplars; the same of filler, whose terms tell more; of a placeholder, which may stand in any sentence.
CONTAINED, COVERED, FILLER_COVERED, SLOT_COVERED = 0.72, 0.60, 0.35, 0.02
#: Least number of different words by which pseudo-Latin is told, and of repetitions.
LATIN_TERMS, REPEATS = 3, 5
#: Weight of a term that no exemplar holds, in units of the mean weight of those that one holds.
OTHER_WEIGHT = 0.8

#: Forms of unfilled placeholders, and the usual names in brackets.
_SLOT_NAMES = r"(?:first|last|full|company|your|customer|client|product|project|file|user|street|e-?mail)?[ _-]?(?:name|company|date|title|address|e-?mail|phone|city|amount|product|url|link|recipient|sender|signature|organi[sz]ation|project|version|position|year|month)"
_SLOTS = re.compile(
    r"\{\{\s*[\w.\- ]{1,40}\s*\}\}|\$\{[\w.\- ]{1,40}\}|#\{[\w.\- ]{1,40}\}|<%=?\s*[\w.\- ]{1,40}\s*%>|\{%\s*[\w.\- ]{1,40}\s*%\}|@@[A-Za-z]\w{0,40}@@|%%[A-Za-z]\w{0,40}%%|"
    r"(?<![\w_])__[A-Z][A-Z0-9_]{0,38}[A-Z0-9]__(?![\w_])|(?<![\w$])\$[A-Z][A-Z0-9_]{1,40}\$(?![\w$])|%\([A-Za-z]\w{0,40}\)[sd]|\[\[\s*[A-Za-z][\w.\- ]{0,40}\s*\]\]|<<\s*[A-Za-z][\w\- ]{0,40}\s*>>|"
    r"<(?:your|insert|enter|add|my)[-_ ][\w\- ]{1,40}>|\[(?:your|insert|enter|add)[ _-][\w\- ]{1,40}\]|\{(?:your|insert)[-_ ][\w\- ]{1,40}\}|(?<![\w/=@$#%{\"'(.])\{[a-z][a-z_]{1,30}\}(?![\w}\"'])|"
    rf"(?<![\w\]])[\[<]{_SLOT_NAMES}[\]>](?![(\[:])",
    re.I,
)
#: With what a placeholder starts; a text without any has none.
_SLOT_OPENERS = ("{", "<%", "@@", "%%", "__", "$", "%(", "[", "<")
_FENCE = re.compile(r"^[ \t]*(```++|~~~++)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"``[^\n]+?``|`[^`\n]+`")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|‘[^’\n]{2,300}’(?!\w)")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b\s*[:=\[]|^\s*\w+ \d+ \d\d:\d\d:\d\d ")
_PROGRAM = re.compile(
    r"^\s*(?:[-+](?:let|const|var|def|fn|return|import|use|print)?\s*\w.*[;{}]|@@ -|(?:let|const|var|def|fn|func|pub|class|struct|impl|return|import|from|package|use|export|static|public|private|protected|if|for|while|switch|match|print|assert|type|namespace|else|elif|with|defer|async|int|void|memset|trace)\b.*[;{}()\[\]:=,]\s*$|"
    r"(?:let|const|var|return|import|use|export|print|log)\b.*[;(=].*|[\w.]+\s*(?::=|[-+*/|]?=)\s*\S.*|[\w.$]+\([^)]*\)\s*[;{]?\s*$|.*[;{]\s*$|[{}()\[\];,]+$|//|/\*|\*(?:\s|/|$)|///|#include|#\[|\"\"\"|'''|\$ |\.\.\. )"
)
_COMMENT = re.compile(r"^\s*(?://+|/\*+|\*+/?|\"\"\"|'''|--)\s?")
_BLOCK = re.compile(r"^\s*(?:>|\|)")
_MARKUP = re.compile(r"^\s*(?:<(?:!doctype|html|head|body|title|center|h\d|hr|p|div|noscript|error|code|message|\?xml)\b|<\?xml|\{\s*\"(?:message|error|status|code|title|detail)\")", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_HTTP = re.compile(r"\bhttp/\d(?:\.\d)?\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=\S)")
#: A status code: after a word that announces it, or first in a passage before a capital, a mark or nothing.
_STATUS = re.compile(r"(?:(?i:\b(?:error|http|status|code|fehler|erreur)\b[\s:#]*)|^[\s#*]*)[45][0-5]\d\b(?=\s*$|\s*[:,;!-]|\s+[A-Z(]|\s+(?i:request|message|error|status))")
_STATUS_LIKE = re.compile(r"(?<![\w.])[45][0-5]\d(?![\w.])")
_TOKEN = re.compile(r"<[a-z]+>|[^\W\d_]+(?:['-][^\W\d_]+)*")
_ASCII_TOKEN = re.compile(r"<[a-z]+>|[a-z]+(?:['-][a-z]+)*")
_DIGIT = re.compile(r"\d")
_IDS = re.compile(r"(?<![\w])(?=[0-9a-f]*\d)[0-9a-f]{8,}(?![\w])|\b[A-Z]\d{3,5}\b")
#: Subjects that vary freely in notices, and words that carry no meaning.
_SUBJECTS = frozenset(
    "app site page pages sitio docs document documents viewer file files snapshot repository branch revision diff code wiki application website "
    "seite anwendung page application página aplicación it service".split()
)
_STOP = frozenset(
    "the a an this that these those our your you we they of to in on is are be been was were and or so but as its it's with for by at from may has have had some not if no "
    "i s t re ll ve m l d n der die das den dem ein eine und um zu sie ist wird le la les un une et pour de des du cette ce el los las una para y esta este se vous nous je tu il elle uns sich".split()
)
#: Letters of a word that make its stem.
STEM = 6


def _lexicon() -> tuple[dict[str, tuple], dict[str, tuple], re.Pattern, dict[str, tuple], dict[str, list[tuple[str, bool]]]]:
    """Whole words, beginnings of words and phrases with their concepts, and each concept's surface forms (form, whether any ending may follow)."""
    whole, start, phrase, forms = {}, {}, {}, {}
    for name, said in CONCEPTS.items():
        for form in (x.strip() for x in said.split("|")):
            bare, star = form.rstrip("*"), form.endswith("*")
            forms.setdefault(f"<{name}>", []).append((bare, star))
            if re.search(r"[ '-]", bare):
                phrase.setdefault(bare + ("*" if star else ""), []).append(f"<{name}>")
            else:
                (start if star else whole).setdefault(bare, []).append(f"<{name}>")
    longest = sorted(phrase, key=lambda x: (-len(x), x))
    found = re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(p.rstrip("*")) + (r"[^\W\d_]*" if p.endswith("*") else r"(?![^\W_])") for p in longest) + ")")
    as_tuple = lambda d: {k: tuple(v) for k, v in d.items()}
    return as_tuple(whole), as_tuple(start), found, as_tuple(phrase), forms


_WHOLE, _START, _PHRASE, _PHRASES, FORMS = _lexicon()
_LONGEST, _SHORTEST = max(map(len, _START)), min(map(len, _START))


@lru_cache(maxsize=1 << 16)
def _term(word: str) -> tuple[str, ...]:
    """The concepts of a word, or its stem; () for words that carry no meaning."""
    if word[0] == "<" or word in _STOP or word in _SUBJECTS:
        return () if word[0] != "<" else (word,)
    hit = _WHOLE.get(word)
    if hit:
        return hit
    for n in range(min(len(word), _LONGEST), _SHORTEST - 1, -1):
        hit = _START.get(word[:n])
        if hit:
            return hit
    if "'" in word:
        head, tail = word.split("'", 1)
        return _term(tail) if len(head) <= 2 else _term(head)
    if "-" in word:
        return tuple(t for part in word.split("-") for t in _term(part))
    return (word[:STEM],) if len(word) > 1 else ()


@lru_cache(maxsize=1 << 12)
def _phrase_terms(said: str) -> str:
    hit = _PHRASES.get(said)
    if hit is None:  # a phrase with any ending
        hit = next(v for k, v in _PHRASES.items() if k.endswith("*") and said.startswith(k[:-1]))
    return " " + " ".join(hit) + " "


def _tokens(low: str) -> list[str]:
    return (_ASCII_TOKEN if low.isascii() else _TOKEN).findall(low)


def _phrase_scan() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for form, told in _PHRASES.items():
        auto.add_word(form.rstrip("*"), (len(form.rstrip("*")), form.endswith("*"), told))
    auto.make_automaton()
    return auto


_SCAN = _phrase_scan()


def _repeats(words: list[str]) -> bool:
    """Whether a list holds one word, or two in turn, over and over."""
    same = list(map(str.__eq__, words, words[2:]))
    return sum(same) >= REPEATS - 2 and any(k and sum(1 for _ in g) >= REPEATS - 2 for k, g in groupby(same))


def terms(text: str) -> list[str]:
    """Terms of a passage: concepts, marks of placeholders, status codes and endless repetition, and stems of other words."""
    text = _SLOTS.sub(f" {SLOT} ", text) if any(x in text for x in _SLOT_OPENERS) else text
    if _DIGIT.search(text):
        text = _IDS.sub(" ", _HTTP.sub(" http ", text))
        if _STATUS_LIKE.search(text):
            text = _STATUS.sub(f" {STATUS} ", text.strip())
    text = text.lower().replace("’", "'")
    words = _tokens(text)
    if len(words) >= REPEATS and len(kinds := set(words)) <= 2 and len(words) >= REPEATS * len(kinds) and SLOT not in kinds and _repeats(words):
        return [REPEAT]
    if next(_SCAN.iter(text), None) is not None:
        words = _tokens(_PHRASE.sub(lambda m: _phrase_terms(m.group()), text))
    return [t for w in words for t in _term(w)]


#: Format characters, which are invisible.
_INVISIBLE = frozenset(chr(c) for c in [*range(0x80, 0x10000), 0xE0001, *range(0xE0020, 0xE0080)] if unicodedata.category(chr(c)) == "Cf")


def _fold(text: str) -> str:
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    for c in _INVISIBLE.intersection(text):
        text = text.replace(c, "")
    return text


_BLANK_LINE = re.compile(r"\n[^\S\n]*(?=\n)")


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs of a text without fenced code; [] for null and blank."""
    if not text or not text.strip():
        return []
    text = _fold(text.replace("\r\n", "\n").replace("\r", "\n"))
    return [p for p in _BLANK_LINE.split(_FENCE.sub("\n\n", text) if "```" in text or "~~~" in text else text) if p.strip()]


def passages(paragraph: str) -> list[str]:
    """The passages of a paragraph, without what it only shows or quotes."""
    out = []
    for line in paragraph.split("\n"):
        if not line.strip() or _BLOCK.match(line) or _LOG.match(line):
            continue
        line = _INLINE.sub(" ", line).strip()
        if not line or "```" in line:
            continue
        if _MARKUP.match(line):  # an error document or a notice in markup, as it came
            bare = re.sub(r"([a-z])([A-Z])", r"\1 \2", line) if "<Error>" in line else line
            bare = html.unescape(_TAG.sub(" ", bare)) if bare.lstrip().startswith("<") else re.sub(r"[{}\"_:,]", " ", bare)
            if re.search(r"[^\W_]", bare):
                out.append(bare.strip())
            continue
        comment = _COMMENT.sub("", line)
        if comment == line and _PROGRAM.match(line) and not re.match(r"^\s*(?:if|for|with|use|type|print|import)\b [^=(){};]*[.!?]$", line, re.I):
            continue
        line = _QUOTED.sub(" ", comment)
        if re.search(r"@(?:param|returns?|type|throws)\b", line):
            continue
        out += [s for s in _SENTENCE.split(line.strip(" \t#*-+>•")) if re.search(r"[^\W_]|\{|\$|%|@@|<|\[", s)]
    return out


@dataclass(frozen=True)
class Exemplar:
    label: str
    terms: frozenset
    contained: float
    covered: float
    least: int = 0


def exemplars() -> list[Exemplar]:
    """The labelled exemplars with the least containment and coverage by which each matches."""
    reasons = [f"{s.value} {s.phrase}" for s in HTTPStatus if s.value >= 400]
    out = [Exemplar("script notice", frozenset(terms(x)), CONTAINED, COVERED) for x in SCRIPT_NOTICES]
    out += [Exemplar("error page", frozenset(terms(x)), CONTAINED, COVERED) for x in [*ERROR_PAGES, *reasons]]
    out += [Exemplar("filler", frozenset(terms(x)), CONTAINED, COVERED) for x in FILLER]
    out += [Exemplar("latin filler", frozenset(t for t in terms(x) if len(t) > 3), 0.0, FILLER_COVERED, LATIN_TERMS) for x in LATIN]
    out += [Exemplar("repeated filler", frozenset(terms(x)), CONTAINED, COVERED) for x in REPEATED]
    out += [Exemplar("placeholder", frozenset([SLOT]), CONTAINED, SLOT_COVERED) for x in PLACEHOLDERS if SLOT in terms(x)]
    out += [Exemplar("legitimate", frozenset(terms(x)), 0.60, 0.0) for x in LEGITIMATE]
    out += [Exemplar("about placeholders", frozenset([SLOT, "<template>"]), 0.99, 0.0) for x in ABOUT_SLOTS if {SLOT, "<template>"} <= set(terms(x))]
    return [e for e in out if e.terms]


class Index:
    """The exemplars' inverted index with corpus weights."""

    def __init__(self, items: list[Exemplar], freq: dict[str, int], docs: int):
        self.items = list(dict.fromkeys(items))
        vocabulary = {t for e in self.items for t in e.terms}
        self.weight = {t: math.log((docs + 1) / (min(docs, freq.get(t, 0)) + 1)) + 0.5 for t in vocabulary}
        self.other = OTHER_WEIGHT * sum(self.weight.values()) / max(1, len(self.weight))
        self.mass = [sum(self.weight[t] for t in e.terms) for e in self.items]
        self.told: dict[str, set] = {}  # all terms of a label's exemplars
        self.postings: dict[str, list[int]] = {}
        self.keys: set[str] = set()
        for i, e in enumerate(self.items):
            self.told.setdefault(e.label, set()).update(e.terms)
            left = self.mass[i]
            for t in sorted(e.terms, key=lambda t: (-self.weight[t], t)):
                # without any of the terms so far, no window can hold the least share
                if left < e.contained * self.mass[i] and e.contained:
                    break
                left -= self.weight[t]
                self.postings.setdefault(t, []).append(i)
                if e.label not in LEGAL:
                    self.keys.add(t)
        self.reach = sum(self.weight[t] for t in vocabulary)
        self.loosest = {la: min(e.covered for e in self.items if e.label == la) for la in self.told}

    def possible(self, have: set[str]) -> bool:
        """Whether a text of these terms may hold a window that matches residue: whether they contain enough of an exemplar."""
        for i in {i for t in self.keys & have for i in self.postings[t]}:
            e = self.items[i]
            if e.label in LEGAL:
                continue
            shared = e.terms & have
            if len(shared) >= e.least and sum(self.weight[t] for t in shared) >= e.contained * self.mass[i] - 1e-9:
                return True
        return False

    def label(self, have: set[str], total: float) -> str | None:
        """Label of the residue exemplar that a window of these terms and this weight matches best, None where none does or something legitimate does as well."""
        found = {i for t in have for i in self.postings.get(t, ())}
        best, label, legit, about = 0.0, None, 0.0, False
        cover: dict[str, float] = {}
        for i in sorted(found):
            e = self.items[i]
            shared = e.terms & have
            inside = sum(self.weight[t] for t in shared) / self.mass[i]
            if e.label == "legitimate":
                legit = max(legit, inside) if inside >= e.contained else legit
                continue
            if e.label == "about placeholders":
                about = about or inside >= e.contained
                continue
            if inside < e.contained:
                continue
            if e.label not in cover:
                told = self.told[e.label] & have
                cover[e.label] = sum(self.weight[t] for t in told) / total if len(told) >= e.least else 0.0
            if cover[e.label] >= e.covered and (score := inside if e.contained else 1.0) > best:
                best, label = score, e.label
        if label == "placeholder":
            return None if about else label
        return label if label is not None and best > legit else None


class Scan:
    """Which terms of a vocabulary a text holds anywhere, quoted or not: at least those of any window of its passages."""

    #: Words that are remembered.
    MEMORY = 1 << 20

    def __init__(self, vocabulary: frozenset):
        self.vocabulary = vocabulary
        self.seen: set[str] = set()
        self.telling: dict[str, tuple] = {}  # those of the seen words that have terms of the vocabulary
        self.mine = lambda told: tuple(t for t in told if t in vocabulary)

    def terms(self, text: str) -> set[str]:
        text = _fold(text)
        if "<" in text:
            text = re.sub(r"([a-z])([A-Z])", r"\1 \2", text) + "\n" + text if "<Error>" in text else text
            text = html.unescape(text) if "&" in text else text
        got = set()
        if any(x in text for x in _SLOT_OPENERS) and _SLOTS.search(text):
            got.add(SLOT)
        if _STATUS_LIKE.search(text):
            got.add(STATUS)
        low = text.lower().replace("’", "'").replace("_", " ")
        words = _tokens(low)
        if _repeats(words):
            got.add(REPEAT)
        words = set(words)
        if len(self.seen) > self.MEMORY:
            self.seen, self.telling = set(), {}
        new = words - self.seen
        for word in new:
            told = self.mine(_term(word))
            if told:
                self.telling[word] = told
        self.seen |= new
        for word in self.telling.keys() & words:
            got.update(self.telling[word])
        end = len(low)
        for at, (n, star, told) in _SCAN.iter(low):
            if (at < n or not low[at - n].isalnum()) and (star or at + 1 >= end or not low[at + 1].isalnum()):
                got.update(self.mine(told))
        return got & self.vocabulary


def find(text: str | None, index: Index, scan: Scan) -> list[str]:
    """Labels of the residue in a text, sorted; [] for a clean, null or blank one.

    A text, and then each of its paragraphs, is passed over where a scan tells
    that its terms contain no exemplar sufficiently: then no window does.
    A window grows from a passage with a term of the exemplars over the following
    passages of its paragraph, until what no exemplar holds outweighs what all exemplars
    together could ever cover.
    """
    got = set()
    if not text or not index.possible(scan.terms(text)):
        return []
    weight, other, keys = index.weight, index.other, index.keys
    most = index.reach * (1 - COVERED) / COVERED
    for par in paragraphs(text):
        if not index.possible(scan.terms(par)):
            continue
        bags = [set(terms(s)) for s in passages(par)]
        keyed = [not keys.isdisjoint(b) for b in bags]
        last = max((i for i, k in enumerate(keyed) if k), default=-1)
        for i in range(last + 1):
            if not keyed[i] and weight.keys().isdisjoint(bags[i]):
                continue
            have: set[str] = set()
            total = foreign = 0.0
            ready = False
            for j in range(i, len(bags)):
                for t in bags[j] - have:
                    w = weight.get(t)
                    total += other if w is None else w
                    foreign += other if w is None else 0.0
                have |= bags[j]
                ready = ready or keyed[j]
                label = index.label(have, total) if ready else None
                if label:
                    got.add("filler" if label == "latin filler" else label)
                    break
                if foreign > most or (j >= last and not ready):
                    break
    return sorted(got)


def _frequencies(docs: DataFrame, text: str, vocabulary: frozenset) -> tuple[dict[str, int], int]:
    """Number of documents that hold each exemplar term, and of all documents with text; at most one row per term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scan(shared.value)
        count: dict[str, int] = {}
        n = 0
        for b in batches:
            for t in b[text]:
                if t and t.strip():
                    n += 1
                    for x in scan.terms(t):
                        count[x] = count.get(x, 0) + 1
        yield pd.DataFrame({"term": [*count, ""], "df": [*count.values(), n]})

    rows = docs.select(text).mapInPandas(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    freq = {r[0]: r[1] for r in rows}
    return freq, freq.pop("", 0)


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, labels) of every row of docs whose text holds residue in place of content; labels is a sorted array.

    Weights come from all documents. Texts without any key term of the index are
    told by one scan; every passage of every other text is compared. Null, empty
    and blank texts, and null keys, are no cases. Repeated texts are each
    reported under their own key.
    """
    items = exemplars()
    vocabulary = frozenset(t for e in items for t in e.terms)
    freq, n = _frequencies(docs, text, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((items, freq, n))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        scan = Scan(frozenset(index.weight))
        for b in batches:
            keys, labels = [], []
            for k, t in zip(b[key], b[text]):
                found = find(t, index, scan)
                if found:
                    keys.append(k)
                    labels.append(found)
            yield pd.DataFrame({key: pd.Series(keys, dtype=b[key].dtype), "labels": pd.Series(labels, dtype=object)})

    return docs.filter(F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, labels array<string>")
