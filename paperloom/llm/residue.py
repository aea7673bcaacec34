"""Problem 10: template residue, filler, error pages and script notices in documents.

Labelled exemplars are retrieved through an inverted index over their most telling tokens;
a passage window that holds enough of an exemplar's TF-IDF weight is a match if it also
makes up at least half of its sentence, so that a text that only speaks about such messages
is none. Words that say the same in such messages are one token. Unfilled slots and filler
words are tokens like any other, and words of writing about text veto matches near them.
The weights come from document frequencies over the whole collection.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import ship

#: Share of an exemplar's weight a window must hold.
COVERAGE = 0.8
#: Words of writing about text that veto a match in one sentence.
CUES = 2

# Words that mean the same in notices and error messages are one token.
CLASSES = {
    "<js>": "javascript scripts scripting script js",
    "<enable>": "enable activate allow turn switch permit unblock reenable",
    "<enabled>": "enabled activated allowed switched turned permitted",
    "<disabled>": "disabled deactivated blocked blocking inactive",
    "<view>": "view see read access use display load continue proceed open show browse enter",
    "<page>": "page site website paper article abstract document content text section app application reader viewer file resource url address preview comments figure references",
    "<loaded>": "loaded displayed converted opened found retrieved shown rendered processed read fetched",
    "<needs>": "requires require needs need required must",
    "<check>": "checking verifying verify confirm prove confirming",
    "<wait>": "seconds minutes moment moments later soon shortly second",
    "<write>": "write add insert fill type enter describe update complete replace put",
    "<down>": "unavailable down offline overloaded",
    "<lorem>": "lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam quis nostrud "
               "exercitation ullamco laboris nisi aliquip consequat duis aute irure reprehenderit voluptate velit cillum fugiat pariatur excepteur occaecat "
               "cupidatat proident officia deserunt mollit anim laborum vivamus mauris pellentesque vestibulum curabitur phasellus suspendisse praesent",
    "<keys>": "asdf qwer jkl zxcv asd qwe sdf dfg fgh hjkl qwerty asdfasdf uiop zxc",
    "<bla>": "bla blah blub blablabla",
    "<foo>": "foo bar baz qux quux",
}

# Labelled exemplars, one a line, in words or tokens of the above. `0` stands for any number,
# `<slot>` for an unfilled slot. A line that starts with `=` is short and must be a passage of
# its own; one that starts with `^` is an order and begins a sentence, of whatever length; one
# that starts with `~` counts wherever it stands.
RESIDUE = """
^please <enable> <js>
^please <enable> on <js>
<enable> <js> to <view> this <page>
<enable> on <js> to <view> the <page>
<enable> <js> in your browser
<js> is <disabled>
<js> <needs> to be <enabled>
<js> is <needs> to <view> this <page>
<js> is not <enabled>
this <page> <needs> <js>
this <page> <needs> <js> and cookies
the <page> works only with <js>
you <needs> to <enable> <js>
you <needs> to <enable> on <js>
your browser does not support <js>
your browser may be <disabled> <js>
if nothing happens within 0 <wait>
if nothing happens click here
please <enable> cookies
cookies <needs> be <enabled>
your browser is out of date
please upgrade your browser
bitte aktivieren sie javascript
bitte schalten sie javascript ein
javascript ist deaktiviert
diese seite benötigt javascript
veuillez activer javascript
javascript est désactivé
activez javascript dans votre navigateur
active javascript en su navegador
habilite javascript en su navegador
por favor active javascript
javascript está desactivado
включите javascript
javascript отключен
для просмотра включите javascript
^请启用javascript
请开启javascript
<check> that you are human
<check> you are human
^<check> your browser
<check> if the <page> connection is secure
^complete the captcha
^please complete the captcha
<check> that you are not a robot
please wait while we <check> your browser
ddos protection by
access denied request id 0
you do not have permission to <view> this <page>
you don't have permission to <view> this <page>
you are not authorized to <view> this <page>
too many requests
you have been <disabled>
your session has expired
session timed out
please log in again
^please log in to <view>
^please sign in to <view>
the requested <page> was not <loaded>
the requested <page> could not be <loaded>
we can't find the <page> you're looking for
the <page> you are looking for does not exist
the <page> you requested does not exist
this <page> does not exist
<page> could not be <loaded>
<page> cannot be <loaded>
this <page> has been removed
this <page> has moved
the <page> is no longer available
this <page> is currently <down>
no <page> available
seite nicht gefunden
die seite konnte nicht gefunden werden
das dokument ist leider nicht verfügbar
zugriff verweigert
ein fehler ist aufgetreten
page introuvable
page non trouvée
la page demandée n'existe pas
le document demandé n'existe pas
accès refusé
une erreur est survenue
página no encontrada
la página no existe
la página solicitada no existe
acceso denegado
se ha producido un error
страница не найдена
доступ запрещен
произошла ошибка
页面不存在
您访问的页面不存在
页面未找到
找不到页面
访问被拒绝
http status 0
http error 0
0 internal server error
error 0 service <down>
error 0 service temporarily <down>
service temporarily <down>
error 0 nothing to <view>
nothing to <view>
<view> error 0
an error occurred
an error occurred while
an unexpected error
something went wrong
oops something went wrong
gateway time out the server did not answer
the server did not answer within 0 <wait>
server error
database connection failed
error establishing a database connection
too many open connections
try again in 0 <wait>
please try again <wait>
err connection refused
err connection timed out
connection timed out
connection refused
traceback most recent call last
null pointer exception
exception report
undefined variable
undefined index
undefined function
failed to open stream
uncaught exception
fatal error
syntax error unexpected
syntax error on line 0
warning undefined on line 0
stack overflow at line 0
<write> your <page> here
<write> <page> here
^<write> acknowledgements here
<write> caption here
your <page> goes here
goes here
<page> here
title of <page>
author name
first author second author
affiliation of first author
keyword 0 keyword 0
keyword keyword keyword
<page> not supplied
authors not supplied
not supplied
todo <write>
fixme <write>
dummy <page>
dummy <page> to be replaced
to be replaced
placeholder for
<write> this <page> with your own
this is placeholder <page>
this is sample <page>
this is a test
~<slot>
~lorem ipsum
~<lorem> <lorem> <lorem> <lorem>
<bla> <bla> <bla>
<keys> <keys> <keys>
<foo> <foo> <foo>
xx xx xx
test test test test
=loading
=loading <page>
=please wait
=just a moment
=access denied
=0 forbidden
=0 unauthorized
=0 not found
=0 bad gateway
=0 bad request
=bad gateway
=0 internal server error
=internal server error
=0 service <down>
=page not found
=file not found
=not found
=gateway time out
=gateway timeout
=<page> folgt
=inhalt folgt
=texte à venir
=à venir
=texto pendiente
=por definir
=текст будет добавлен
=sample <page>
=placeholder
=placeholder <page>
=tbd
=tba
=tbc
=to be determined
=to be announced
=to be added
=to be completed
=coming soon
=under construction
=untitled
=untitled document
=object object
=undefined
=null
=nan
"""

# Words of writing about text, for all matches, and of reporting, for messages.
ABOUT = set(
    "template templates templating slot slots placeholder placeholders variable variables brace braces bracket brackets syntax notation shell macro macros "
    "parser tag tags expanded expands substituted substitution rendered renders string strings filler phrase stimulus stimuli language literal quoted".split())
REPORT = ABOUT | set(
    "we our participants annotators crawl crawled corpus dataset study trials trial experiment measure measured message messages answered answer "
    "returned responded excluded filtered removed readers subjects pages mirrors rates rate percent fraction".split())

# Words that name a field of a form.
_FIELD = (
    "title|author|authors|name|names|abstract|date|year|affiliation|institution|institute|email|doi|url|link|citation|keyword|keywords|journal|volume|issue|"
    "reviewer|editor|conference|venue|grant|funder|university|department|city|country|address|paper|id|number|text|content|summary|caption|acknowledgements"
)

# Of these, no names of HTML elements.
_ANGLE = "author|authors|name|names|date|year|affiliation|institution|institute|email|doi|url|keyword|keywords|journal|volume|issue|reviewer|venue|grant|funder|university|city|country"

# No pattern is bounded in length: each scan ends at the next opening sign or line end.
_SLOT = "|".join((
    r"\{\{\s*[A-Za-z_][\w.-]*(?:(?: +| *\| *)[\w.-]+)*\s*\}\}", r"\{%(?:(?!\{%).)*?%\}", r"<%(?:(?!<%).)*?%>", r"[$#]\{\s*[A-Za-z_][\w.-]*\s*\}(?!\$)",
    r"%[A-Z][A-Z_]{2,}%", r"<<\s*[A-Z][A-Z0-9_ ]+>>", rf"<<\s*(?i:{_FIELD})\s*>>", r"@@\w+@@", r"(?<!\w)__[A-Z][A-Z0-9_]+__(?!\w)", r"\[\[\s*[A-Z][A-Z_ ]{2,}\]\]",
    rf"(?<![\w$#{{\\}}])\{{(?:[A-Za-z]+_)*(?i:{_FIELD})(?:_[A-Za-z]+)*\}}(?!\}})", r"<\s*(?i:insert|enter|your)\s[^<>\n]+>", rf"<(?i:{_ANGLE})>",
    r"\[\s*(?i:insert|enter|your|todo|tbd|placeholder)\b[^\[\]\n]*\]", r"\[\s*(?i:[a-z]+ (?:name|number|title|date|address|here|not supplied))\s*\]",
    r"(?<=: )_{6,}", r"\[(?i:object object)\]",
))
# Words come first: no slot begins with a letter or digit, and most tokens are words.
_TOKEN = re.compile(
    rf"(?P<word>[^\W\d_]+(?:['\u2019][^\W\d_]+)*)|(?P<num>\d+(?:[.,]\d+)*)|(?P<gap>[\n\r.!?;:\u3002\uff01\uff1f]+)(?<!\?\?)"
    rf"|(?=[{{<$#%@_\[])(?P<slot>{_SLOT})|(?P<open>\?\?)"
)
_HAN = re.compile(r"[㐀-鿿]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SLOT_TOKEN, _NUMBER = "<slot>", "0"
_CLASS_OF = {w: c for c, words in CLASSES.items() for w in words.split()}


def tokenize(text: str) -> tuple[list[str], list[bool], list[bool]]:
    """Lower-case tokens and, for each, whether a passage begins there and whether it was
    capitalized. Numbers are one token, unfilled slots another; Han characters stand alone;
    a slot's own words follow it, since instructions often stand inside a slot."""
    out: list[str] = []
    starts: list[bool] = []
    caps: list[bool] = []
    add, mark, cap = out.append, starts.append, caps.append
    fresh = True
    for m in _TOKEN.finditer(text):
        kind, w = m.lastgroup, m[0]
        if kind == "word":
            if w.isascii():
                low = w.lower()
                add("xx" if low[0] == "x" and len(w) > 1 and not low.strip("x") else low)
                mark(fresh), cap(w[0] != low[0])
            else:
                for x in re.findall(r"[㐀-鿿]|[^㐀-鿿]+", w) if _HAN.search(w) else (w,):
                    low = x.lower().replace("\u2019", "'")
                    add(low)
                    mark(fresh), cap(x[0] != low[0])
                    fresh = False
            fresh = False
        elif kind == "gap":
            fresh = True
        elif kind == "slot":
            add(_SLOT_TOKEN)
            mark(fresh), cap(False)
            fresh = False
            if w[0] == "[" and w[1] != "[":
                for x in _LETTERS.findall(w):
                    add(x.lower())
                    mark(False), cap(False)
        else:
            add(_NUMBER if kind == "num" else w)
            mark(fresh), cap(False)
            fresh = False
    return out, starts, caps


@dataclass(frozen=True)
class Exemplar:
    """A labelled text: its token counts, and where it counts: in a sentence it makes up
    half of (``own``), begins (``first``) or is (``alone``), or anywhere (``any``)."""

    tokens: tuple[str, ...]
    where: str


def exemplars(lines: str = RESIDUE) -> list[Exemplar]:
    """The labelled library."""
    out = []
    for line in lines.strip().split("\n"):
        where = {"=": "alone", "~": "any", "^": "first"}.get(line[0], "own")
        words: list[str] = []
        for w in line.lstrip("=~^").split():
            words += [w] if w in CLASSES or w == _SLOT_TOKEN else [_CLASS_OF.get(x, x) for x in tokenize(w)[0]]
        out.append(Exemplar(tuple(words), where))
    return list(dict.fromkeys(out))


def vocabulary() -> set[str]:
    """Every token of the library and its words of speaking about text: a few hundred."""
    return {w for e in exemplars() for w in e.tokens}


def _size(e: Exemplar) -> int:
    """Length of the windows in which an exemplar is sought: longer ones may be interrupted."""
    n = len(e.tokens)
    return n if n < 3 else n + (1 if n < 5 else n // 3)


class Matcher:
    """The inverted index of the exemplars, weighted by ``df`` over ``n_docs`` documents."""

    def __init__(self, df: dict[str, int], n_docs: int, coverage: float = COVERAGE, library: list[Exemplar] | None = None):
        self.coverage = coverage
        self.items = exemplars() if library is None else library
        vocab = {w for e in self.items for w in e.tokens}
        self.idf = {w: math.log((n_docs + 2) / (df.get(w, 0) + 1)) + 0.1 for w in vocab}
        self.counts = [Counter(e.tokens) for e in self.items]
        self.weight = [sum(self.idf[w] * c for w, c in k.items()) for k in self.counts]
        self.index: dict[str, list[int]] = {}
        for i, k in enumerate(self.counts):
            need = (1 - coverage) * self.weight[i]
            seen = 0.0
            for w in sorted(k, key=lambda w: (-self.idf[w], w)):  # without these, coverage is out of reach
                self.index.setdefault(w, []).append(i)
                seen += self.idf[w] * k[w]
                if seen > need:
                    break

    def _windows(self, i: int, tokens: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
        """Windows of exemplar ``i`` within [lo, hi) that reach the coverage, without what
        isn't the exemplar's at their ends."""
        k, size = self.counts[i], _size(self.items[i])
        need = self.coverage * self.weight[i] - 1e-9
        have: Counter[str] = Counter()
        got, out = 0.0, []
        for at in range(lo, hi):
            w = tokens[at]
            if w in k:
                have[w] += 1
                if have[w] <= k[w]:
                    got += self.idf[w]
            gone = at - size
            if gone >= lo and (x := tokens[gone]) in k:
                if have[x] <= k[x]:
                    got -= self.idf[x]
                have[x] -= 1
            if got >= need and w in k:
                first = max(lo, gone + 1)
                while tokens[first] not in k:
                    first += 1
                out.append((first, at + 1))
        return out

    def _stands(self, where: str, tokens: list[str], starts: list[bool], caps: list[bool], a: int, b: int) -> bool:
        """Whether a window may stand for its exemplar where it is, and nothing vetoes it. A
        capital letter begins a sentence, too, but words before it still veto."""
        lo, hi = a, b
        while lo > 0 and not starts[lo]:
            lo -= 1
        while hi < len(tokens) and not starts[hi]:
            hi += 1
        around = [*tokens[lo:a], *tokens[b:hi]]
        if where == "alone":
            if hi > b or a - lo > (2 if lo and b - a > 1 else 1 if b - a > 1 else 0):
                return False
        elif where == "own" and sum(w not in tokens[a:b] for w in (tokens[b:hi] if caps[a] else around)) > b - a:
            return False
        elif where == "first" and lo < a and not caps[a]:
            return False
        words = ABOUT if where == "any" else REPORT
        return sum(w in words for w in around) < CUES

    def matches(self, text: str) -> bool:
        """Whether a text holds residue."""
        return self.first_match(text) is not None

    def first_match(self, text: str) -> str | None:
        """The first exemplar found in a text that stands for itself, as words."""
        tokens, starts, caps = tokenize(text)
        tokens = [_CLASS_OF.get(w, w) for w in tokens]
        done: set[tuple[int, int, int]] = set()
        for p, w in enumerate(tokens):
            for i in self.index.get(w, ()):
                e = self.items[i]
                reach = _size(e)
                for a, b in self._windows(i, tokens, max(0, p - reach), min(len(tokens), p + reach)):
                    if (a, b, i) not in done:
                        done.add((a, b, i))
                        if self._stands(e.where, tokens, starts, caps, a, b):
                            return " ".join(e.tokens)
        return None


def _count_tokens(vocab: frozenset[str], text_col: str):
    """Local document frequencies of the library's tokens, emitted once a task."""

    def run(batches):
        df: Counter[str] = Counter()
        n = 0
        for b in batches:
            for t in b.column(text_col).to_pylist():
                n += 1
                if t:
                    df.update(vocab.intersection([_CLASS_OF.get(w, w) for w in tokenize(t)[0]]))
        yield pa.RecordBatch.from_arrays([pa.array([*df, ""], pa.string()), pa.array([*df.values(), n], pa.int64())], ["token", "n"])

    return run


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """Document frequency of each library token and the number of documents, over all rows.
    Only these few hundred sums reach the driver."""
    ship(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(_count_tokens(frozenset(vocabulary()), text_col), "token string, n long")
    df = {r["token"]: r["n"] for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return df, df.pop("", 0)


def _flag(matcher: Matcher, keep: list[str], text_col: str):
    def run(batches):
        for b in batches:
            flags = [bool(t) and matcher.matches(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(flags, pa.bool_())], [*keep, "residue"])

    return run


def flag_residue(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, residue) for every row. Whole texts are read, without a shuffle; null, empty
    and blank texts hold no residue; copies are judged alike; other columns are not read."""
    matcher = Matcher(*document_frequencies(docs, text_col))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(_flag(matcher, [key], text_col), f"`{key}` {kind}, residue boolean")
