"""Template residue and error-page text (problem 1).

A passage (a line of text, a block of a page) is residue if one of its sentences is: an unfilled placeholder by the
grammar of its delimiters, filler text, an error message, a notice that scripts are needed, or values that a template
printed without having them. Sentences that speak about such things are no residue: messages must open their sentence,
filler words need density, and placeholders are weighed against their surroundings. What a tutorial looks like (the
sentence explains, names a template language, quotes; neighbouring sentences and passages explain; code stands around)
counts against the density of placeholders in the sentence. No rule depends on how long a sentence or a text is.

A page's title counts as a passage of its own. A page's notices in ``noscript`` and code are not its content. Only passages that hold a trigger are looked at
closely; triggers are plain substrings, so whole texts are scanned at memory speed.

Defined cases: null, empty and blank texts and bodies hold no residue; a body that can't be decoded is read as
Latin-1; repeated rows are found once; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from http import HTTPStatus
from re import _constants, _parser

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.functions.html import decoded, passages

_NAME = r"[^\W\d_][\w .:-]{0,60}"
_PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{1,120}%\}|[$#]\{[^{}\n]{1,80}\}|<%[^<>\n]{0,80}%>|<<\s*" + _NAME + r"\s*>>|\[\[\s*" + _NAME + r"\s*\]\]|@@\w{2,60}@@"
    r"|\|\*\s?\w{2,60}\s?\*\||\*\|[\w:]{2,60}\|\*|%[^\W\d_][\w.]{2,60}%|\b__[^\W\d_][\w.]{1,60}__|\bXX[\w.]{3,60}XX\b"
    r"|\[\s*(?:insert|enter|add|your|type|fill|edit|tbd|todo|tbc)\b[^\[\]\n]{0,60}\]|\[[A-Z][A-Z .:_-]{2,60}\]|\{\s*[^\W\d_][\w. ]{0,60}\|[^{}\n]{0,40}\}|\{[^\W\d_]\w*[._]?\w+\}",
    re.I,
)
_CAPITALS = re.compile(r"\[[^\[\]]+\]")
_FIELD = re.compile(
    r"\b(?:name|title|date|deadline|phone|e-?mail|address|campus|room|course|code|department|faculty|advisor|summary|intro|text|program(?:me)?|term|hours|award|office|contact|page|url|link|city|school"
    r"|(?:user|first|last|full|nick|sur|file)[ _-]?name|user|login|company|customer|client|recipient|sender|student|teacher|amount|price|total|street|zip|country|state|day|month|year|time|location|subject|message|description|website|logo|image)\b",
    re.I,
)
_ABOUT = re.compile(
    r"\b(?:such as|for example|e\.g\.|merge fields?|how (?:each|the|a) (?:field|placeholder|variable)|syntax|template (?:language|engine)s?|is written|are written|are filled in|is filled in|(?:we|you|students?) (?:learn|write|read)"
    r"|tutorial|par exemple|zum beispiel|por ejemplo)\b",
    re.I,
)
_TALK = re.compile(
    r"\b(?:placeholders?|merge (?:fields?|tags?)|mail merge|templates?|templating|interpolat\w+|(?:template|shell|environment) variables?|liquid|jinja2?|mustache|handlebars|twig|smarty|freemarker|thymeleaf|velocity|blade|erb|jsp|django|angular|vue)\b",
    re.I,
)
_SAID = re.compile(r"\b(?:uses?|writes?|prints?|renders?|outputs?|evaluates?|expands?|escapes?|called|named|write|type|typing|writing)\W{1,3}$", re.I)
_MEANS = re.compile(r"^\W{1,3}(?:stands? for|means?|expands?|renders?|prints?|refers?|evaluates?|denotes?|yields?|outputs?|will be replaced|is replaced)\b", re.I)
_QUOTES = ("`", "'", '"', "“", "‘", "«", "„")
_CODE = re.compile(r"^(?:```|\s{4,}\S.*[;{}()=]|\t\S.*[;{}()=])|[;{]\s*$|\b(?:def|function|return|var|const|import|echo|printf?)\b.*[();]")

#: Words of the usual filler text. (Fixed values.)
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum pellentesque tellus cursus mauris vivamus felis porta arcu nec non sem eget nunc lectus vestibulum habitant morbi tristique senectus "
    "netus malesuada fames turpis egestas vitae ante nibh praesent blandit lacinia erat integer posuere ultrices proin sodales donec rhoncus massa ligula curabitur suspendisse viverra".split()
)
MASHED = frozenset("test asdf qwer qwerty xxxx xxx blah foo bar baz hjkl zxcv lkj dummy abc aaa text".split())
_WORDS = re.compile(r"[^\W\d_]+")

_FILLER = re.compile(
    r"^(?:(?:this|here) is (?:a |some )?(?:dummy|sample|placeholder|filler|example) (?:copy|text|content|paragraph)\b|(?:sample|dummy|placeholder|filler|example) (?:text|copy|content|paragraph)\b"
    r"|replace (?:it|this(?: text| paragraph)?) with your own\b|(?:type|enter|insert|put|write|add|place) (?:your|the|some) [\w ]{0,20}(?:text|content|copy|title|heading|name|description)? ?here\b"
    r"|(?:your|sub-?|the )?\s?(?:sub-?heading|heading|title|text|content|headline|caption|quote|summary) (?:goes |comes )?here\b|your [\w ]{1,20}(?: goes)? here\b|click here to edit\b|click to (?:edit|add)\b"
    r"|add a (?:short )?(?:description|summary|title|caption|heading|text)\b.{0,40}\bhere\b|(?:todo|fixme|tbd)\s*[(:\[]|copy to come\b|content coming soon\b"
    r"|blindtext\b|(?:dies(?:er|es) ist )?(?:ein )?(?:blindtext|platzhaltertext|mustertext|beispieltext)\b|texte (?:d['’ ]?exemple|de remplissage|factice|fictif)\b|faux[- ]texte\b"
    r"|texto (?:de (?:ejemplo|relleno|muestra|prueba)|ficticio|simulado)\b)",
    re.I,
)
_REPEATED = re.compile(r"^((?:placeholder|sample|dummy|filler)\b[\w .]{0,40}?)(?:\s+\1){1,}\W*$", re.I)
_VALUES = re.compile(r"(?:^|[.;,|]\s*)[\w ]{1,30}:\s*(?:undefined|null|none|nan(?:/nan)*|\[object object\]|#n/a|#ref!?|#value!?|#name\?|#div/0!?|invalid date)(?=\W|$)|\[object Object\]|#REF!|#DIV/0!|NaN/NaN", re.I)

#: Reason phrases of all error codes of HTTP, from the standard library's table.
_STATUS = "|".join(re.escape(x.phrase.lower()) for x in HTTPStatus if x >= 400)

_ERROR = re.compile(
    r"^(?:(?:error|http|http error|(?:http )?status(?: code)?)\W{0,3})?(?:[45]\d\d)\s*[-–—:|]?\s*(?:error\b|page not found|not found|forbidden|gone|bad request|bad gateway|unauthori[sz]ed|internal server|service (?:temporarily )?unavailable|gateway|upstream|too many|method not|request)"
    r"|^(?:http )?(?:status|error)(?: code)?\W{0,3}[45]\d\d\b|^[45]\d\d\W{1,3}(?:" + _STATUS + r")|^(?:http/\d(?:\.\d)? )[45]\d\d\b|^error (?:establishing|connecting|loading|opening|processing|executing|retrieving|fetching|rendering|while|on line|code\W)"
    r"|^an? (?:[\w-]+ ){0,3}(?:error|exception) (?:has |was )?(?:occurr?ed|encountered|thrown|raised)\b|^the (?:requested |specified )(?:url|page|resource|document|file|address)\b.{0,80}\b(?:not found|not available|no longer|unavailable|could not be|can ?not be|does not exist|is denied)\b|^(?:exception|stack ?trace)\W{0,2} (?:in|at|of)\b"
    r"|^(?:error|erreur|fehler|fehlercode)\W{0,3}[45]\d\d\b|^(?:the )?(?:page|document|resource|file|url)(?: you (?:asked for|requested|are looking for))? (?:was |is |could )?(?:not |cannot )(?:be )?found"
    r"|^(?:sorry|oops|uh[- ]oh|whoops|we['’]re sorry|we are sorry)\b.{0,12}(?:\b(?:we|that|this|the|something|an?|page|could|can|went)\b|$)|^(?:we|i) (?:could not|couldn['’]t|cannot|can['’]t) find (?:that|the|this|your) (?:page|file|resource)"
    r"|^something went wrong\b|^(?:an? )?(?:unexpected |unknown |internal |application |fatal |parse |database |server )+(?:server )?error\b(?! (?:messages?|pages?|handling|codes?|rates?|logs?|terms?|analysis|budgets?))|^access (?:is |was )?(?:denied|forbidden)\b"
    r"|^you (?:lack|do not have|don['’]t have) (?:the )?permissions?\b|^(?:the )?(?:service|server|site|website|page|database) (?:is |was )?(?:temporarily |currently |now )?(?:unavailable|down|offline|overloaded)\b"
    r"|^(?:your|the) session (?:has |was )?(?:timed out|expired|ended)\b|^traceback \(most recent|^(?:warning|notice|fatal error|parse error|deprecated): .{0,80}(?:failed|undefined|unexpected|on line \d|in /)|^uncaught (?:exception|error)\b|^(?:\w+\.)*\w*(?:error|exception): "
    r"|^(?:could not|cannot|can['’]t|failed to|unable to) (?:connect|load|open|establish|reach|find|retrieve)\b.{0,60}|^(?:connection|request) (?:timed out|refused|reset)\b|^(?:the )?(?:connection|request|operation) (?:has )?timed out|^upstream (?:timed out|request)|^(?:gateway|bad gateway|proxy error)\b"
    r"|^the address you asked for does not exist|^checking (?:if )?your (?:browser|connection)\b|^(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?human|^(?:please )?complete the captcha|^(?:this )?(?:site|page) is (?:down|under) (?:for )?(?:maintenance|construction|upkeep)"
    r"|^(?:la )?page (?:demandée )?(?:est |n['’]a pas été |n['’]existe |que vous )?(?:introuvable|trouvée|pas trouvée)|^page introuvable|^erreur (?:interne|serveur|de connexion)|^(?:ce )?service (?:est )?(?:temporairement )?indisponible|^accès (?:refusé|interdit)|^(?:votre )?session a expiré"
    r"|^(?:die|diese) (?:angeforderte )?seite (?:wurde|konnte|existiert|ist)\b.{0,20}\b(?:nicht|gefunden|verfügbar)|^seite nicht gefunden|^(?:interner )?serverfehler|^zugriff (?:verweigert|verboten)|^(?:der )?dienst (?:ist )?(?:vorübergehend )?nicht (?:verfügbar|erreichbar)|^(?:ihre )?sitzung ist abgelaufen"
    r"|^(?:no se (?:encontró|ha encontrado|pudo encontrar)) la página|^(?:la )?página (?:solicitada )?(?:no (?:encontrada|existe|se encontró|disponible))|^error (?:interno|del servidor|de conexión)|^acceso (?:denegado|prohibido)|^(?:el )?servicio (?:no disponible|temporalmente)|^(?:su )?sesión ha (?:caducado|expirado)",
    re.I,
)
_SCRIPTS = re.compile(
    r"^(?:please |you (?:must|need to|have to|should) |kindly )?(?:enable|allow|turn on|activate|switch on) (?:java)?scripts?\b|^(?:(?:it (?:looks|seems) (?:like|that|as if) )?(?:your )?(?:java)?script(?:s|ing)? (?:is|are|must be|seems?|appears?)(?: to be)? (?:turned |switched )?(?:off|disabled|required|enabled|needed|not enabled|blocked))"
    r"|^(?:this|the|our|some)(?: [\w-]+){1,3} (?:needs?|requires?|relies on|works only with|does not work without|doesn['’]t work without|(?:can ?not|can['’]t|won['’]t|will not) \w+ without) (?:client-side )?(?:java)?script(?:s|ing)?\b|^it (?:looks|seems) (?:like|that) (?:java)?scripts? "
    r"|^(?:the )?use of (?:java)?script(?:s|ing)? (?:is|must be) (?:required|necessary|needed|mandatory|enabled)\b|^(?:java)?script(?:s|ing)? (?:has|have) been (?:disabled|turned off|blocked|switched off)\b|^(?:to|in order to) (?:use|view|see|continue|access|run|enter)\b.{0,80}\b(?:enable|turn on|allow|activate|switch on) (?:java)?scripts?"
    r"|^without (?:java)?scripts?\b.{0,60}\b(?:cannot|can['’]t|won['’]t|will not|does not|doesn['’]t|not)\b|^you (?:have|need|must have) (?:java)?script(?:s|ing)? (?:to be )?(?:disabled|turned off|switched off|blocked|enabled|turned on)\b|^(?:java)?script(?:s|ing)? (?:needs|has|have|need) to be (?:enabled|turned on|allowed)\b|^no (?:java)?scripts?,? no\b"
    r"|^unsupported browser\b|^your browser (?:has (?:them|scripts|javascript)|does not support|doesn['’]t support|is (?:not supported|out of date|too old))|^loading\s?(?:…|\.{2,3})?.{0,40}\b(?:allow|enable|scripts?|javascript)\b|^if nothing appears within\b.{0,60}\bscripts?\b"
    r"|^turn it on and reload\b|^(?:cette page|ce site|cette application|le site) (?:nécessite|requiert|a besoin de|exige) (?:que )?(?:javascript|les? scripts?)|^(?:veuillez )?activ(?:ez|er) (?:javascript|les? scripts?)|^javascript (?:est|ist|está) (?:désactivé|deaktiviert|desactivado|requis|erforderlich|necesario)"
    r"|^(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:javascript|skripte?)|^(?:diese seite|diese anwendung) (?:benötigt|braucht|erfordert) (?:javascript|skripte?)|^(?:por favor,? )?(?:active|habilite|activa|habilita) javascript|^(?:esta página|este sitio|esta aplicación) (?:necesita|requiere) (?:javascript|scripts?)",
    re.I,
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_LEAD = re.compile(r"^[\W_]*?(?=[\w\[{<$#@%|*(]|__)", re.S)
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_SPACES = re.compile(r"\s+")

_MARKS = set("[]{}<>%@|*#$_")


def required(tree) -> set[str] | None:
    """Substrings of the lower-cased text, one of which whatever a parsed rule matches holds; None if it has none.

    Of a sequence the part whose shortest substring is longest counts (rare marks weigh like letters more), of
    alternatives all. Substrings hold no white space, so they are found before runs of it are joined.
    """
    parts, run = [], ""
    for op, value in [*tree, (None, None)]:
        if op is _constants.LITERAL and not chr(value).isspace():
            run += chr(value).lower()
            continue
        if run:
            parts.append({run})
        run, found = "", None
        if op is _constants.SUBPATTERN:
            found = required(value[-1])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0]:
            found = required(value[2])
        elif op is _constants.BRANCH:
            sets = [required(x) for x in value[1]]
            found = None if None in sets else set().union(*sets)
        if found:
            parts.append(found)
    return max(parts, key=lambda x: min(len(t) + 3 * bool(_MARKS & set(t)) for t in x), default=None)


def _triggers(rule: re.Pattern) -> set[str]:
    found = required(_parser.parse(rule.pattern, rule.flags & re.I))
    if not found:
        raise ValueError(f"a rule has an alternative without a trigger: {rule.pattern[:60]}")
    return found


#: Substrings of the lower-cased text, one of which every sentence that a rule can take holds, read off the rules.
TRIGGERS = {
    "placeholder": _triggers(_PLACEHOLDER),
    "filler": _triggers(_FILLER) | _triggers(_REPEATED),
    "values": _triggers(_VALUES),
    "error": _triggers(_ERROR),
    "scripts": _triggers(_SCRIPTS),
}
#: Filler text holds two of these.
_LONG = frozenset(w for w in LOREM if len(w) > 3)
#: Mashed keys: three words of four are of ``MASHED`` or one repeated letter, so two of them stand side by side.
_MASHED = r"(?:([^\W\d_])\%d*|" + "|".join(sorted(MASHED)) + r")"
_PAIR = re.compile(r"[\W\d_]" + _MASHED % 1 + r"[\W\d_]+" + _MASHED % 2 + r"[\W\d_]")


def _filler_words(sentence: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(sentence)]
    if len(words) >= 4:
        latin = sum(w in LOREM for w in words)
        if latin >= 4 and latin >= 0.5 * len(words) and len({w for w in words if w in LOREM and len(w) > 3}) >= 2:
            return True
        if sum(w in MASHED or len(set(w)) == 1 for w in words) >= 0.75 * len(words) and len(set(words)) <= 0.8 * len(words):
            return True
    return False


def _unfilled(sentence: str) -> list[re.Match]:
    """The placeholders of a sentence; what stands in single brackets must read like a field."""
    out = []
    for m in _PLACEHOLDER.finditer(sentence):
        own = m.group()
        if _CAPITALS.fullmatch(own) and not own.startswith("[[") and not re.match(r"\[\s*(?:insert|enter|add|type|fill|your)\b", own, re.I):
            inside = own[1:-1].strip()
            if not (_FIELD.search(inside) or inside.isupper() and len(inside) > 3):
                continue
        out.append(m)
    return out


def _placeholders(sentence: str, around: int) -> bool:
    """Whether a sentence's placeholders were left unfilled rather than spoken about; ``around``: how much its
    neighbourhood reads like a tutorial."""
    found = _unfilled(sentence)
    if not found:
        return False
    if _ABOUT.search(sentence):
        return False
    rest = _PLACEHOLDER.sub(" ", sentence)
    covered = sum(len(m.group()) for m in found) / len(sentence)
    told = around + 2 * bool(_TALK.search(rest))
    for m in found:
        before, after = sentence[: m.start()], sentence[m.end() :]
        told += 2 * bool(_SAID.search(before) or _MEANS.match(after)) + 2 * (before.rstrip("([")[-1:] in _QUOTES)
    return told < (2 if covered < 0.5 and len(found) < 3 else 4)


def _matched(sentence: str, kinds: set[str], around: int | None) -> str | None:
    if "placeholder" in kinds and around is not None and _placeholders(sentence, around):
        return "placeholder"
    if "values" in kinds and _VALUES.search(sentence):
        return "values"
    if "words" in kinds and _filler_words(sentence) or "filler" in kinds and (_FILLER.match(sentence) or _REPEATED.match(sentence)):
        return "filler"
    if "error" in kinds and _ERROR.match(sentence):
        return "error"
    if "scripts" in kinds and _SCRIPTS.match(sentence):
        return "scripts"
    return None


def _kind(sentence: str, kinds: set[str], around: int | None) -> str | None:
    """The kind of residue a sentence is, of the ``kinds`` whose triggers its passage holds; ``around`` None: in code."""
    kind = _matched(sentence, kinds, around)
    return None if kind and _ABOUT.search(sentence) else kind


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """All triggers in one pass over a text, built once a worker; each gives its kinds, and itself if it is of ``_LONG``."""
    automaton = ahocorasick.Automaton()
    for t in set().union(*TRIGGERS.values(), _LONG):
        automaton.add_word(t, (t if t in _LONG else None, *(kind for kind, listed in TRIGGERS.items() if t in listed)))
    automaton.make_automaton()
    return automaton


def triggered(passage: str) -> set[str]:
    """The kinds of residue that the passage's triggers allow, 'words' for filler text known by its words."""
    low = passage.lower()
    found = {x for _, x in _automaton().iter(low)}
    kinds = {k for x in found for k in x[1:]}
    if len([x for x in found if x[0]]) > 1 or _PAIR.search(f" {low} "):
        kinds.add("words")
    return kinds


def _is_code(passage: str) -> bool:
    return bool(_CODE.search(passage)) and not _VALUES.search(passage)


def _explains(sentence: str) -> bool:
    return bool(_ABOUT.search(sentence) or _TALK.search(sentence))


def residue_kind(passage: str, around: int = 0) -> str | None:
    """'placeholder', 'filler', 'error', 'scripts' or 'values' if one of the passage's sentences is residue.

    ``around``: points that the neighbouring passages give for a tutorial, 1 if they explain, 1 if they are code."""
    kinds = triggered(passage)
    if not kinds:
        return None
    code = "placeholder" in kinds and _is_code(passage)
    flat = _SPACES.sub(" ", passage).strip()
    sentences = _SENTENCES.split(flat)
    for k, sentence in enumerate([*sentences, flat] if len(sentences) > 1 else sentences):
        lead = _LEAD.match(sentence)
        told = around
        if "placeholder" in kinds and len(sentences) > 1 and k < len(sentences):
            told += any(_explains(x) for x in sentences[max(0, k - 1) : k] + sentences[k + 1 : k + 2])
        kind = _kind(sentence[lead.end() :] if lead else sentence, kinds, None if code else told)
        if kind:
            return kind
    return None


def first_residue(lines: list[str]) -> str | None:
    """The kind of the first residue among passages; those between code fences are no content (a fence that is never
    closed is none), and the two passages on either side are a passage's surroundings."""
    marks = [i for i, line in enumerate(lines) if line.lstrip().startswith("```")]
    fenced = {i for a, b in zip(marks[::2], marks[1::2]) for i in range(a, b + 1)}
    for i, line in enumerate(lines):
        if i in fenced or not line or line.isspace():
            continue
        kind = residue_kind(line)
        if kind == "placeholder":  # only then do the surroundings matter
            near = [k for k in (i - 2, i - 1, i + 1, i + 2) if 0 <= k < len(lines)]
            code = any(k in fenced or _is_code(lines[k]) for k in near)
            kind = residue_kind(line, code + any(_explains(lines[k]) for k in near if k not in fenced))
        if kind:
            return kind
    return None


def residue_in_texts(df: DataFrame, record: str = "document_id", text: str = "full_text") -> DataFrame:
    """record_id, residue of each record whose text holds residue."""

    def run(ids: list, texts: list) -> tuple:
        found = [(i, first_residue(t.split("\n")) if t else None) for i, t in zip(ids, texts)]
        found = [x for x in found if x[1]]
        return [i for i, _ in found], [k for _, k in found]

    own = df.select(F.col(record).cast("bigint").alias("record_id"), F.col(text).alias("text"))
    return map_columns(own.where("record_id is not null and text is not null"), run, "record_id bigint, residue string").distinct()


def residue_in_pages(df: DataFrame, record: str = "fetch_id", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """record_id, residue of each page whose own blocks hold residue."""

    def run(ids: list, kinds: list, bodies: list) -> tuple:
        out: tuple = ([], [])
        for i, kind, b in zip(ids, kinds, bodies):
            if b:
                page = decoded(b, kind)
                named = _TITLE.search(page)
                residue = (residue_kind(html.unescape(named[1])) if named else None) or first_residue(passages(page))
                if residue:
                    out[0].append(i)
                    out[1].append(residue)
        return out

    own = df.select(F.col(record).cast("bigint").alias("record_id"), F.col(content_type).alias("kind"), F.col(body).alias("body"))
    return map_columns(own.where("record_id is not null and body is not null"), run, "record_id bigint, residue string").distinct()


def without_residue(df: DataFrame, record: str = "document_id", text: str = "full_text") -> DataFrame:
    """``df`` without the records whose text holds residue."""
    found = residue_in_texts(df, record, text).select(F.col("record_id").alias("_residue")).distinct()
    return df.join(found, df[record] == F.col("_residue"), "left_anti")


def pages_without_residue(df: DataFrame, record: str = "fetch_id", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """``df`` without the pages whose own blocks hold residue."""
    found = residue_in_pages(df, record, body, content_type).select(F.col("record_id").alias("_residue")).distinct()
    return df.join(found, df[record] == F.col("_residue"), "left_anti")
