"""Template residue, filler, error pages and script notices inside texts."""

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: a field name as templates write it
NAME = r"[^\W\d_][\w.\-]{0,30}(?: [\w.\-]{1,30}){0,3}"
UPPER = r"[^\W\d_a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ0-9_]{1,40}"

# fixed values: one grammar for every delimiter
PLACEHOLDERS = {
    "moustache": rf"\{{\{{\{{?[#/^&>!]?\s*{NAME}(?:\s*\|\s*[\w: '\"]+)*\s*\}}?\}}\}}",
    "path": r"\{\{\s*[^\W\d]\w*(?:\.\w+|\[['\"]?\w+['\"]?\])+\s*(?:\|[^{}\n]*)?\}\}",
    "php": r"<\?(?:php|=)\s[^?\n]+\?>",
    "named_format": r"(?<![\w%])%\([^\W\d]\w*\)[sdif](?!\w)",
    "tag": r"\{%-?\s*(?:block|if|for|include|extends|set|end\w+|else|load|url)\b[^%{}\n]{0,80}%\}",
    "erb": rf"<%[=\-]?\s*@?{NAME}(?:\(\))?\s*-?%>",
    # variables of the shell are no template's fields
    "shell": rf"\$\{{\s*(?!(?:HOME|PATH|PWD|SHELL|LANG|TMPDIR|PYTHONPATH|JAVA_HOME|SPARK_HOME)\s*\}}){NAME}\s*\}}",
    "hash": rf"#\{{\s*{NAME}\s*\}}",
    "brace": r"(?<![\w{$#%\\}])\{[^\W\d_]\w{0,40}\}(?![}\w])",
    "percent": rf"(?<![\w%])%(?:{UPPER}|[^\W\d_]\w{{1,40}})%(?![\w%])",
    "at": rf"@@{NAME}@@",
    "dunder": r"(?<![\w.])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![\w.(])",
    "merge": r"\*\|[A-Z][A-Z0-9_:]{1,40}\|\*",
    "xxxx": r"\bX{3,}_[A-Z0-9_]+?_X{3,}\b",
    "double_angle": rf"<<\s*{NAME}\s*>>",
    "entity": rf"&lt;\s*(?!/|\w+\s*/?&gt;.{{0,400}}&lt;/){NAME}\s*&gt;",
    "your_here": r"(?i:<\s*(?:your|insert|enter|su|votre|ihr|tu) [\w ]{1,50}?(?: here| aquí| ici| hier)?\s*>)",
    "double_square": rf"\[\[\s*{NAME}\s*\]\]",
    "square": r"\[(?:INSERT|ENTER|ADD|YOUR|EINFÜGEN|INSERTAR|INSÉRER)[ :][^\[\]\n]{1,60}\]|\[[^\[\]\n]{1,60} (?:HERE|AQUÍ|ICI|HIER)\]|\[(?:TBD|TODO|TBC|TK|FIXME)(?:\s*:[^\[\]\n]{1,60})?\]"
    # in mixed case too, but for the texts of links and for cross-references
    r"|(?i:\[(?:(?:insert|enter|add|your|einfügen|insertar|insérer)[ :][^\[\]\n]{1,60}|(?!(?:click|see|look|read|tap|press|go|found|siehe|voir|ver) )[^\[\]\n]{1,60} (?:here|aquí|ici|hier)|(?:tbd|todo|tbc|tk|fixme)(?:\s*:[^\[\]\n]{1,60})?)\](?![(\[]))"
    # names of form fields
    r"|(?i:\[(?:first|last|full|company|customer|client|recipient|sender|product|project|event|contact|street|city|postal|zip|phone|order|invoice|due|start|end|job)[ _](?:name|address|code|number|date|time|title|email|amount|person|id)\](?![(\[]))",
    "object": r"\[object Object\]",
    "blank_value": r"\b(?:Dear|Hello|Hi|Hola|Bonjour|Cher|Chère|Liebe|Lieber|Welcome back,?) (?:undefined|null|NaN|None)\b",
}

# fixed values: the words of Latin filler
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor tempora incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat fugit nulla pariatur excepteur "
    "sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae cursus purus libero augue massa porta felis eros quam velum vel "
    "urna dictum mollis ornare maecenas diam eget risus varius blandit justo odio dapibus facilisis egestas vestibulum ligula semper praesent nullam integer posuere erat ante "
    "venenatis aenean lacinia bibendum etiam malesuada euismod cras mattis fermentum vivamus sagittis lacus tellus tortor mauris condimentum nibh donec ullamcorper metus auctor "
    "fringilla pellentesque habitant morbi tristique senectus netus turpis phasellus viverra"
)

# fixed values: other filler, behind the words of which a text must hold one
FILLER = [
    ("lorem ipsum", r"\blorem ipsum\b"),
    (" here", r"\b(?:headline|title|subtitle|text|content|caption|description|copy|body|image|name|your (?:text|content|headline|title|copy|message|name))(?: goes| comes)? here\b(?! (?:is|are|was|were|the|a|an|in|and|but|we|to|that)\b)"),
    ("sample|layout|dummy|filler", r"\bsample (?:paragraph |body )?text\b|\bfor layout purposes\b|\b(?:dummy|filler) text\b"),
    ("placeholder", r"\bplaceholder text\b(?:\W+placeholder text\b)*"),
    ("to be |coming soon", r"\b(?:description|summary|content|text|details|abstract) (?:to be (?:added|written|supplied)|coming soon)\b"),
    ("your ", r"\b(?:write|type|enter|put) your (?:\w+ )?(?:summary|text|content|description|message|title|abstract) (?:in this box|here|below)\b"),
    ("title of the page", r"\btitle of the page\b ?/ ?\w+"),
    ("asdf", r"\basdf(?:[ ;]+(?:asdf|qwer|jkl|zxcv|qwerty)){1,}\b"),
    ("test test", r"\b(test)(?: \1){2,}\b"),
    ("bla", r"\b(bla|blah)(?:[ ,]+\1){2,}\b"),
    ("relleno|texto simulado|texto de ejemplo|aquí", r"\btexto (?:de relleno|simulado|de ejemplo)\b|\baquí (?:va|irá|viene|iría) (?:el|su|tu) (?:texto|título|contenido)\b"),
    ("blindtext|platzhalter|fülltext|hier ", r"\bblindtext\b|\bplatzhaltertext\b|\bfülltext\b|\bhier (?:steht|kommt|folgt) (?:später |noch |bald )?(?:ein |der |ihr )?(?:text|titel|inhalt)\b"),
    ("remplissage|factice|texte d|faux|ici ", r"\btexte (?:de remplissage|factice|d'exemple)\b|\bfaux[- ]texte\b|\bici (?:viendra|va|vient|figurera) (?:le|votre) (?:texte|titre|contenu)\b"),
]

# fixed values: reasons that servers send with a status
REASON = (
    "not found|forbidden|bad gateway|service (?:temporarily )?unavailable|internal server error|gateway time-?out|too many requests|gone|unauthorized|unauthorised|bad request|"
    "request time-?out|method not allowed|proxy authentication required|not implemented|moved permanently|page not found|access denied"
)
_start = r"(?:^|(?<=[.!?:>\n] )|(?<=[\n>\"]))\s*"
ERRORS = [
    ("http", rf"\bhttp(?:/\d(?:\.\d)?)? (?:status )?[345]\d\d (?:{REASON})\b"),
    ("error|erreur|fehler", rf"\b(?:error|erreur|fehler|http error|fehlercode|código de error)(?: code)? ?[45]\d\d ?(?::|-|–|—|\()"),
    ("not |forbidden|gateway|unavailable|error|requests|gone|unauthor|bad |time|denied|required|moved", rf"\b[45]\d\d[ :\-–—]+(?:{REASON})\b"),
    ("nicht gefunden|introuvable|no encontrada", r"\b(?:error|fehler|erreur)[^.\n]{0,12}\b[45]\d\d\b[^.\n]{0,6}(?:seite nicht gefunden|page introuvable|página no encontrada)"),
    ("nicht gefunden|introuvable|no encontrada", r"\b(?:seite nicht gefunden|page introuvable|página no encontrada)\b"),
    ("page not found|server error", _start + r"(?:page not found|internal server error)(?=\s*(?:[.!]|\n|$))"),
    ("non trouvée|nicht gefunden|encontr", _start + r"(?:page non trouvée|die seite (?:konnte|wurde) nicht gefunden(?: werden)?|no se (?:encontró|ha encontrado|pudo encontrar) la página)(?=\s*(?:[.!]|\n|$))"),
    ("find th|page", r"\bwe could ?n[o']?t find (?:that|the|this) page\b|\bwe could not find (?:that|the|this) page\b|\bgo back to the (?:start|home) ?page\b"),
    ("page you", r"\b(?:the|this) page (?:you are looking for|you requested|you were looking for) (?:does not|doesn't|no longer|could not|cannot|can't) (?:exists?|be found)\b"),
    ("this page|empty response", r"\bthis page (?:isn't|is not) (?:working|available)\b|\bthe server sent an empty response\b"),
    ("went wrong|oops", r"\bsomething went wrong(?: on our (?:side|end))?[.!]|\boops! (?:something|that page|we )"),
    ("database|error", r"\berror establishing (?:a|the) database connection\b|\b(?:database|mysql|sql) (?:connection )?error:"),
    ("fatal|traceback|rendering", r"\bfatal error: (?:uncaught|call to|allowed memory|maximum execution|out of memory|exception)\b|\btraceback(?:: template rendering failed| \(most recent call last\):)|\btemplate rendering failed\b"),
    ("permission", r"\b(?:you do not|you don't) have permission to (?:view|access) this (?:resource|page|content|file|server)\b"),
    ("denied|denegado|refusé|verweigert", _start + r"access denied[.!]|" + _start + r"(?:acceso denegado|accès refusé|zugriff verweigert)[.!]"),
    ("session|sign in", r"\byour session has (?:expired|timed out)\b|\bsign in again to continue\b"),
    ("sesión|sitzung|anmelden|melden|session|connecter", r"\b(?:su|tu) sesión ha (?:caducado|expirado)\b|\binicie sesión[.!]|\bihre sitzung ist abgelaufen\b|\bbitte melden sie sich (?:erneut )?an\b|\bvotre session a expiré\b|\bveuillez vous (?:re)?connecter\b"),
    ("requests|retry|rate limit", r"\btoo many requests[.!]|\bslow down and retry in \d+ (?:seconds|minutes)\b|\brate limit exceeded\b"),
    ("blocked", r"\brequest blocked[.!]? ?reference (?:no|number|id)\b|" + _start + r"request blocked[.!]"),
    ("maintenance|be back", r"\bwe are (?:down for|undergoing) (?:scheduled )?maintenance\b|\bsite is under maintenance\b|\bwill be back (?:soon|shortly)[.!]"),
    ("requested", r"\bthe requested (?:resource|url|page|file)(?: [^.\n]{1,60})? (?:is temporarily unavailable|is unavailable|was not found|could not be found|is not available)\b"),
    ("no existe|disponible", r"\bla página solicitada (?:ya )?no existe\b|\bel servicio no está disponible\b"),
    ("angeforderte|dienst", r"\bdie angeforderte seite existiert nicht\b|\bder dienst ist (?:vorübergehend|derzeit|momentan) nicht (?:erreichbar|verfügbar)\b"),
    ("demandée|indisponible", r"\bla page demandée n['’ ]?(?:existe|est) (?:plus|pas)\b|\ble service est (?:momentanément|temporairement|actuellement) indisponible\b"),
]

# fixed values: notices that scripts are required
SCRIPTS = [
    ("noscript", r"<noscript\b[^>]*>"),
    ("script", r"\b(?:please )?(?:enable|activate|turn on|allow) java ?script (?:to|in|and|for|or|on)\b|\bplease (?:enable|activate) java ?script[.!]"),
    ("script", r"\byou need to (?:enable|activate|turn on|allow) (?:java ?script|scripts)\b"),
    ("script", r"\bjava ?script (?:is|must be|has to be|needs to be|appears to be|seems to be) (?:currently )?(?:disabled|required|turned off|switched off|enabled|off)\b(?! for)"),
    ("script", r"\b(?:comments?|this (?:app|site|page|application|website)|viewing this \w+) (?:requires?|needs?) (?:java ?script|(?:client-side )?scripts?)\b"),
    ("script", r"\byour browser does not (?:support|allow|run) (?:java ?script|(?:client-side )?scripts?)\b"),
    ("script|browser", r"\bscript execution is (?:switched|turned) off\b|\bscripts and cookies must be (?:allowed|enabled)\b|\bchecking your browser before\b"),
    ("script", r"\bactive (?:java ?script|los scripts) (?:para|en)\b|\bsu navegador tiene java ?script (?:desactivado|deshabilitado)\b|\besta (?:aplicación|página) (?:necesita|requiere) (?:que los scripts|java ?script|scripts)\b|\bhabilite java ?script\b"),
    ("script", r"\bsie müssen java ?script (?:aktivieren|einschalten)\b|\bvous devez (?:activer|autoriser) java ?script\b|\b(?:debe|tiene que|necesita) (?:activar|habilitar) java ?script\b"),
    ("skript|script", r"\bbitte aktivieren sie java ?script\b|\bihr browser führt keine (?:skripte|scripts) aus\b|\bdiese (?:anwendung|seite) (?:benötigt|braucht|erfordert) (?:aktivierte |aktives )?(?:skripte|scripts|java ?script)\b|\bjava ?script ist (?:deaktiviert|ausgeschaltet|in ihrem browser (?:deaktiviert|ausgeschaltet))\b"),
    ("script", r"\bveuillez activer (?:java ?script|les scripts)\b|\bjava ?script est (?:désactivé|requis|nécessaire)\b|\bcette (?:application|page) (?:exige|nécessite|requiert) (?:des scripts|java ?script|les scripts)\b|\bvotre navigateur (?:n['’]exécute|ne prend|n['’]accepte)\b[^.\n]{0,20}scripts?\b"),
]

# fixed values: words of sentences that speak about templates and pages instead of being such
TALK = (
    r"\b(?:placeholders? (?:tokens?|such|like)|such as|for example|e\.g\.|in the template|the template|template (?:syntax|language|engine)|report writer|replaces? (?:the|each|every|all|it|them|an?)|we write|syntax|"
    r"die vorlage|platzhalter wie|la plantilla|le gabarit|users asked|should be dropped|logged|the words?|mit dem code|with code|the message|messages? (?:like|such)|crawled pages|"
    r"the regex|regular expression|tutorial|documentation says|we (?:saw|see|got|hit|counted))\b"
)

# what a text must hold, in lower case, before a placeholder grammar is tried
MARKS = {
    "moustache": ("{{",), "path": ("{{",), "php": ("<?",), "named_format": ("%(",), "tag": ("{%",), "erb": ("<%",), "shell": ("${",), "hash": ("#{",), "brace": ("{",), "percent": ("%",), "at": ("@@",), "dunder": ("__",), "merge": ("*|",),
    "xxxx": ("xxx",), "double_angle": ("<<",), "entity": ("&lt;",), "your_here": ("<",), "double_square": ("[[",), "square": ("[",), "object": ("[object",), "blank_value": ("undefined", "null", "nan", "none"),
}
LATIN_WORDS = frozenset(LATIN.split())
WORD = re.compile(r"[^\W\d_]+")

OPEN, CLOSE = "`\"'“„«‘‚”‹", "`\"'”“»’‘›"
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code)\b[^>]*>.*?(?:</\1>|\Z)|`[^`\n]+`", re.S | re.I)
FORMAT = re.compile("[­؀-؅؜۝܏᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻]")
BLANK = re.compile(r"\n[^\S\n]*\n")
SPACE = re.compile(r"[^\S\n]+")
QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]|(?<!\w)'[^'\n]+'(?!\w)")

KINDS = {
    "placeholder": [(MARKS[name], re.compile(p)) for name, p in PLACEHOLDERS.items()],
    "filler": [(tuple(n.split("|")), re.compile(p, re.I)) for n, p in FILLER],
    "error_page": [(tuple(n.split("|")), re.compile(p, re.I | re.M)) for n, p in ERRORS],
    "script_notice": [(tuple(n.split("|")), re.compile(p, re.I)) for n, p in SCRIPTS],
}
TALKS = re.compile(TALK, re.I)
SENTENCE = re.compile(r"[.!?](?=\s)|\n")


def plain(text: str) -> str:
    """Format characters taken out, every run of blanks one space, line breaks kept."""
    return SPACE.sub(" ", FORMAT.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))


def latin_runs(t: str, low: str, least: int = 6) -> list[tuple[int, int]]:
    """Passages of at least ``least`` words of Latin filler in a row."""
    words = low.replace(".", " ").replace(",", " ").split()
    if LATIN_WORDS.isdisjoint(words) or sum(map(LATIN_WORDS.__contains__, words)) < least:
        return []
    runs, start, end, n = [], 0, 0, 0
    for m in WORD.finditer(t):
        if m.group().lower() in LATIN_WORDS:
            start = m.start() if not n else start
            n, end = n + 1, m.end()
            continue
        if n >= least:
            runs.append((start, end))
        n = 0
    return [*runs, (start, end)] if n >= least else runs


def find_residue(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of residue in ``plain(text)``, without what is only quoted or discussed.

    A hit in a code block, in back ticks or in quotation marks does not count, nor does one whose
    sentence speaks about templates or messages.  A text of several code blocks that teaches
    templates keeps such hits out by the same rule: what stands in a block is code, and a hit
    between blocks counts only if no cue stands in its sentence and, in its paragraph with the code
    that paragraph touches, hits in code do not outnumber the ones outside three to one.
    """
    t = plain(text)
    inside = lambda spans, a, b: any(x <= a and b <= y for x, y in spans)
    low = t.lower()
    found = [("filler", a, b) for a, b in latin_runs(t, low)]
    for kind, patterns in KINDS.items():
        for needles, p in patterns:
            if any(n in low for n in needles):
                found += [(kind, *m.span()) for m in p.finditer(t)]
    if not found:
        return []
    code = [m.span() for m in CODE.finditer(t)]
    quotes = [m.span() for m in QUOTED.finditer(t)] if any(c in t for c in "\"“«„'") else []
    # a blank line inside a code block ends no paragraph
    breaks = [m.start() for m in BLANK.finditer(t) if not inside(code, m.start(), m.end())]
    ends = [0, *(m.end() for m in SENTENCE.finditer(t))]
    hits, coded = [], Counter()
    for kind, a, b in found:
        while a < b and t[a].isspace():
            a += 1
        if inside(code, a, b):
            coded[bisect(breaks, a)] += kind == "placeholder"
            continue
        if (a and t[a - 1] in OPEN and b < len(t) and t[b] in CLOSE) or inside(quotes, a, b):
            continue
        at = bisect(ends, a) - 1
        if not TALKS.search(t, ends[at], a):
            hits.append((kind, a, b))
    placed = Counter(bisect(breaks, a) for k, a, _ in hits if k == "placeholder")
    return [h for h in hits if h[0] != "placeholder" or coded[bisect(breaks, h[1])] <= 3 * placed[bisect(breaks, h[1])]]


def template_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds, hits, share): the documents that hold residue; anti-join them to exclude it.

    ``kinds`` names what was found (placeholder, filler, error_page, script_notice), comma-separated in
    order of name; ``hits`` counts the passages, ``share`` is the part of the plain text they cover.

    Method: a grammar for each placeholder delimiter and regular expressions for filler, error pages
    and script notices in four languages; hits in code, in quotes or in sentences that talk about such
    things are discounted, and placeholders of paragraphs full of template code are too (``find_residue``).
    Whole texts are searched.  Null, empty and blank texts, and rows with a null key, give no row; a
    repeated row gives one row each time; other columns are ignored.
    """

    @F.pandas_udf("kinds string, hits int, share double")
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for t in part:
                found = find_residue(t) if t else []
                covered, end = 0, 0
                for _, a, b in sorted(found, key=lambda h: h[1:]):
                    covered += max(0, b - max(a, end))
                    end = max(end, b)
                rows.append((",".join(sorted({k for k, _, _ in found})), len(found), round(covered / max(1, len(plain(t))), 6) if found else 0.0))
            yield pd.DataFrame(rows, columns=["kinds", "hits", "share"])

    seen = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, look(F.col(text)).alias("_r"))
    return seen.filter("_r.hits > 0").select(key, "_r.kinds", "_r.hits", "_r.share")
