"""A tolerant parser of mixed markup: candidate nodes, their tree and their features.

The scanner proposes every span that could be an element of HTML, Markdown, wiki text or
LaTeX, decoys included; a classifier decides later. A node's parent is the smallest node
that holds it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names, LaTeX commands and environments that are common in papers.
HTML_NAMES = set(
    "a abbr article aside b big blockquote body br caption center cite code col colgroup dd del dfn div dl dt em figure "
    "figcaption font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd li link main mark math meta nav "
    "ol p pre q s samp script section small source span strike strong style sub sup svg table tbody td tfoot th thead "
    "title tr tt u ul var video wbr ref nowiki".split())
TEX_WORDS = set(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi "
    "chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega sum prod int oint frac dfrac sqrt lim log ln exp sin cos "
    "tan min max sup inf det dim le leq ge geq ne neq approx sim equiv propto infty partial nabla times cdot cdots ldots dots "
    "pm mp to rightarrow leftarrow mapsto in notin subset cup cap forall exists left right big mathbb mathcal mathbf mathrm "
    "mathit text textbf textit texttt textsc textrm emph underline overline hat bar tilde vec dot it bf em rm tt sc sf cite "
    "citep citet ref eqref label section subsection subsubsection paragraph item begin end footnote caption includegraphics "
    "title author url href ss ae oe aa o l v c u H k r t d b quad qquad hbox mbox rm hspace vspace newline noindent centering "
    "par small large verb usepackage documentclass input newcommand def otimes oplus langle rangle ell hbar dagger circ star".split())
VERBATIM = {"verbatim", "lstlisting", "minted", "alltt"}
MATH_ENVS = {"equation", "align", "eqnarray", "gather", "multline", "displaymath", "math", "array", "matrix"}

KINDS = (
    "h_tag h_element h_comment h_entity h_escaped t_env t_halfenv t_command t_group t_symbol t_display t_inline t_dollar t_dollars "
    "m_heading m_setext m_bold m_bold_ m_italic m_italic_ m_code m_fence m_link m_item m_number m_quote m_table m_rule m_strike "
    "w_heading w_quotes w_link w_template w_table w_item w_external w_magic").split()
KIND_ID = {k: i for i, k in enumerate(KINDS)}
LANGUAGE = {"h": "html", "t": "latex", "m": "markdown", "w": "wiki"}
#: Kinds whose content is literal, and the languages that may still occur inside.
OPAQUE = {"h_comment": "", "m_fence": "", "m_code": "", "t_display": "t", "t_inline": "t", "t_dollar": "t", "t_dollars": "t"}

_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:\s[^<>]*)?)(/?)>")
_PATTERNS = [
    ("h_comment", re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.S)),
    ("h_entity", re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{0,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")),
    ("h_escaped", re.compile(r"&lt;/?[A-Za-z][\w:.-]*(?:\s(?:(?!&[lg]t;)[^<>])*)?/?&gt;|&lt;!--.*?--&gt;", re.S)),
    ("t_display", re.compile(r"\\\[.*?\\\]", re.S)),
    ("t_inline", re.compile(r"\\\(.*?\\\)", re.S)),
    ("t_dollars", re.compile(r"\$\$[^$]+\$\$")),
    ("t_command", re.compile(r"\\(?!begin\b|end\b)[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}]*\})*")),
    ("t_group", re.compile(r"\{\\(?:it|em|bf|tt|sc|rm|sf|sl|cal)\b\s?[^{}]*\}")),
    ("t_symbol", re.compile(r"\\(?:['\"`^~=.](?:\{?\\?[A-Za-z]?\}?)|[%$&#_{},;:!/ @|-]|\\)")),
    ("m_heading", re.compile(r"^ {0,3}#{1,6}[ \t]+\S[^\n]*", re.M)),
    ("m_setext", re.compile(r"^[^\n]*\w[^\n]*\n[ \t]{0,3}(?:={2,}|-{2,})[ \t]*$", re.M)),
    ("m_bold", re.compile(r"\*\*(?=[^\s*])(?:(?!\n\n)[^*])*?(?<=\S)\*\*")),
    ("m_bold_", re.compile(r"(?<!_)__(?=[^\s_])(?:(?!\n\n).)*?(?<=[^\s_])__(?!_)", re.S)),
    ("m_italic", re.compile(r"(?<![*\\])\*(?![\s*])(?:(?!\n\n)[^*\n])+?(?<!\s)\*(?!\*)")),
    ("m_italic_", re.compile(r"(?<![_\\])_(?![\s_])(?:[^_\n])+?(?<![\s_])_(?!_)")),
    ("m_fence", re.compile(r"^[ \t]*(```|~~~)[^\n`]*\n.*?(?:\n[ \t]*\1[ \t]*$|\Z)", re.M | re.S)),
    ("m_code", re.compile(r"(?<!`)`(?!`)[^`\n]+`(?!`)|``(?!`)[^\n]+?``(?!`)")),
    ("m_link", re.compile(r"!?\[[^\[\]\n]*\]\([^()\n]*\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^\[[^\[\]\n]+\]:[ \t]+\S+|<https?://[^\s<>]+>", re.M)),
    ("m_item", re.compile(r"^[ \t]{0,6}[-+*][ \t]+\S[^\n]*", re.M)),
    ("m_number", re.compile(r"^[ \t]{0,6}\d{1,3}[.)][ \t]+\S[^\n]*", re.M)),
    ("m_quote", re.compile(r"^ {0,3}>[ \t]?\S[^\n]*", re.M)),
    ("m_table", re.compile(r"(?:^[ \t]*\|[^\n]*\|[ \t]*\n)?^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-*:?[ \t]*)+$(?:\n[ \t]*\|[^\n]*\|[ \t]*$)*", re.M)),
    ("m_rule", re.compile(r"(?<=\n)[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", re.M)),
    ("m_strike", re.compile(r"~~(?=\S)[^~\n]+~~")),
    ("w_heading", re.compile(r"^(={1,6})[ \t]*[^=\n](?:[^\n]*?[^=\n])??[ \t]*\1[ \t]*$", re.M)),
    ("w_quotes", re.compile(r"'''''[^'\n].*?'''''|'''[^'\n].*?'''|(?<!')''(?!')(?:[^'\n]|(?<=\w)'(?=\w))+?''(?!')")),
    ("w_link", re.compile(r"\[\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\]")),
    ("w_template", re.compile(r"\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}")),
    ("w_table", re.compile(r"^[ \t]*\{\|.*?^[ \t]*\|\}", re.M | re.S)),
    ("w_item", re.compile(r"^(?!\*\*[^\s*][^*\n]*\*\*)[*#:;]{1,4}[ \t]*\S[^\n]*", re.M)),
    ("w_external", re.compile(r"(?<!\[)\[https?://[^\s\]]+(?: [^\]\n]*)?\](?!\()")),
    ("w_magic", re.compile(r"__[A-Z]{3,20}__|~~~~~?")),
]
_BEGIN = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_DOLLAR = re.compile(r"(?<![\\$])\$(?!\$)")
#: No character of any candidate: such texts have no nodes and are not parsed.
PLAIN = re.compile(r"[<&\\$*_`\[\{'=|>#~+:;-]|^[ \t]*\d", re.M)


@dataclass
class Node:
    """A candidate element; ``body`` is its content's span and ``name`` its tag or command."""

    start: int
    end: int
    kind: str
    name: str = ""
    body: tuple[int, int] = (0, 0)
    attrs: str = ""
    closed: bool = True
    children: list[Node] = field(default_factory=list)
    depth: int = 0
    parent: Node | None = None
    on: bool = False
    logit: float = 0.0


def _tags(text: str) -> list[Node]:
    out, open_tags = [], []
    places: dict[str, list[int]] = {}  # of the open tags of each name
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if m[1]:
            if places.get(name):
                i = places[name][-1]
                o = open_tags[i]
                for t in open_tags[i:]:
                    places[t.name].pop()
                del open_tags[i:]
                out.append(Node(o.start, m.end(), "h_element", name, (o.end, m.start()), o.attrs))
            else:
                out.append(Node(m.start(), m.end(), "h_tag", name, (m.end(), m.end()), m[3], False))
        elif m[4] or m[3].endswith("/") or name in ("br", "hr", "img", "wbr"):
            out.append(Node(m.start(), m.end(), "h_tag", name, (m.end(), m.end()), m[3].rstrip("/")))
        else:
            places.setdefault(name, []).append(len(open_tags))
            open_tags.append(Node(m.start(), m.end(), "h_tag", name, (m.end(), m.end()), m[3], False))
            out.append(open_tags[-1])
    elements = {n.start for n in out if n.kind == "h_element"}
    return [n for n in out if n.kind == "h_element" or n.start not in elements or n.closed]


def _environments(text: str) -> list[Node]:
    out, stack = [], []
    for m in _BEGIN.finditer(text):
        name = m[2].rstrip("*")
        if m[1] == "begin":
            stack.append((name, m))
        elif stack and stack[-1][0] == name:
            o = stack.pop()[1]
            out.append(Node(o.start(), m.end(), "t_env", name, (o.end(), m.start())))
        else:
            out.append(Node(m.start(), m.end(), "t_halfenv", name, (m.end(), m.end()), closed=False))
    out += [Node(m.start(), m.end(), "t_halfenv", n, (m.end(), m.end()), closed=False) for n, m in stack]
    return out


_LEAD = re.compile(r"^(?:\\[A-Za-z]+\*?|[#>]+|[-+*]|\d+[.)]|\W+)")


def parse(text: str) -> list[Node]:
    """Candidate nodes in order of start, outer before inner, with parents and depths."""
    if not text or not PLAIN.search(text):
        return []
    nodes = _tags(text) if "<" in text else []
    if "\\begin" in text or "\\end" in text:
        nodes += _environments(text)
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            s, e = m.span()
            lead = _LEAD.match(m[0])
            name = lead[0].lstrip("\\") if lead else ""
            nodes.append(Node(s, e, kind, name, (s + (lead.end() if lead else 0), e)))
    at = [m.start() for m in _DOLLAR.finditer(text)]
    nodes += [Node(a, b + 1, "t_dollar", "$", (a + 1, b)) for a, b in zip(at, at[1:])]
    nodes.sort(key=lambda n: (n.start, -n.end, KIND_ID[n.kind]))
    stack: list[Node] = []
    for n in nodes:
        while stack and (stack[-1].end < n.end or stack[-1].end <= n.start):
            stack.pop()
        if stack:
            n.parent, n.depth = stack[-1], stack[-1].depth + 1
            stack[-1].children.append(n)
        stack.append(n)
    return nodes


def _cls(c: str) -> int:
    """0 none, 1 blank, 2 letter, 3 digit, 4 other."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


_ATTR = re.compile(r"""\s*(?:[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))""")
_MATHY = re.compile(r"[\\^_]|\w\s*=|^\s*\w['*]?\s*$|\w\([\w, ]*\)")
_WORD = re.compile(r"[A-Za-z]{3,}")
_WIKI_START, _MARKDOWN_START = re.compile(r"\W*(?:\[\[|''|\{\{)"), re.compile(r"[\s#>*+\d.)-]*(?:\*\*\S|__\S|`|!?\[[^\[\]]*\]\()")


def features(text: str, nodes: list[Node]) -> list[list[float]]:
    """One row per node: its kind, surroundings, content, attributes, depth, subtree
    density and what its siblings and the whole field look like."""
    by_kind = Counter(n.kind for n in nodes)
    by_lang = Counter(n.kind[0] for n in nodes)
    # siblings by kind, by language and in all, counted once a parent
    kinds = Counter((id(n.parent), n.kind) for n in nodes)
    langs = Counter((id(n.parent), n.kind[0]) for n in nodes)
    brood = Counter(id(n.parent) for n in nodes)
    size = max(len(text), 1)
    rows = []
    for n in nodes:
        row = [0.0] * len(KINDS)
        row[KIND_ID[n.kind]] = 1.0
        before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
        body = text[n.body[0] : n.body[1]]
        inner = body.strip("*_`'[]{}$|=# ")
        same, alike = kinds[id(n.parent), n.kind], langs[id(n.parent), n.kind[0]]
        attrs = n.attrs.strip()
        good = sum(len(m[0]) for m in _ATTR.finditer(n.attrs)) if attrs else 0
        line_start = not n.start or text[n.start - 1] == "\n"
        line_end = n.end >= len(text) or text[n.end] == "\n"
        name = n.name.rstrip("*")
        if n.kind in ("h_tag", "h_element"):
            known = n.name in HTML_NAMES or n.name.startswith("jats:") or n.name.startswith("mml:")
        elif n.kind == "h_entity":
            known = text[n.start + 1] == "#" or text[n.start + 1 : n.end] in html.entities.html5
        elif n.kind == "t_command":
            known = name in TEX_WORDS
        elif n.kind in ("t_env", "t_halfenv"):
            known = True
        else:
            known = False
        letters = sum(c.isalpha() for c in body)
        digits = sum(c.isdigit() for c in body)
        children = n.children
        covered = sum(c.end - c.start for c in children)
        width = max(len(body), 1)
        row += [
            _cls(before), _cls(after), float(before in ("", "\n", " ")), float(before == ":"), float(after == "\\"),
            float(text[max(0, n.start - 2) : n.start].count("\\") > 0),
            _cls(inner[:1]), _cls(inner[-1:]), _cls(body[:1]), _cls(body[-1:]),
            float(min(len(body), 500)), letters / width, digits / width, float(len(_WORD.findall(body)) > 3),
            float(len(_WORD.findall(body))), float(bool(_MATHY.search(body))), float("{" in text[n.start : n.end]), float(" " in inner),
            float(line_start), float(line_end), float(known), float(n.closed),
            float(bool(attrs)), good / max(len(n.attrs), 1) if attrs else 0.0, float(any(w in ("and", "or", "then", "is") for w in attrs.split())),
            float(n.depth), float(len(children)), covered / max(n.end - n.start, 1),
            float(min(same, 20)), float(min(alike, 40)), same / brood[id(n.parent)], alike / brood[id(n.parent)],
            float(by_lang[n.kind[0]] / max(len(nodes), 1)), (n.end - n.start) / size,
            float(n.parent is not None and n.parent.kind[0] == n.kind[0]), float(KIND_ID[n.parent.kind] + 1 if n.parent else 0),
            float(bool(_WIKI_START.match(text, n.start, n.end))), float(bool(_MARKDOWN_START.match(text, n.start, n.end))),
            float(text[n.end : n.end + 2] == "\n\n"), float(len(n.name)), float(text[n.end : n.end + 2].strip() == n.name[:1] != ""),
            float(by_kind["m_bold"] + by_kind["m_bold_"] + by_kind["m_link"]), float(by_kind["w_link"] + by_kind["w_heading"]),
        ]
        rows.append(row)
    return rows


def _allowed(outer: Node) -> str | None:
    """Languages that may occur inside a node that is on; None: all."""
    if outer.kind in OPAQUE:
        return OPAQUE[outer.kind]
    if outer.kind == "t_env":
        return "" if outer.name in VERBATIM else "t" if outer.name in MATH_ENVS else None
    if outer.kind == "h_element" and outer.name in ("pre", "code", "script", "style"):
        return "h"
    if outer.kind == "h_element" and outer.name == "math":
        return "h"
    return None


_CONTEXTS = (None, "", "t", "h")


def _without_conflicts(nodes: list[Node]) -> list[Node]:
    """Nodes in order of start of which no two cross or share a span; the likelier stays."""
    kept: list[Node] = []
    stack: list[Node] = []
    for n in sorted(nodes, key=lambda n: (n.start, -n.end, -n.logit)):
        while stack and stack[-1].end <= n.start:
            stack.pop()
        stay = True
        while stack and (stack[-1].end < n.end or (stack[-1].start, stack[-1].end) == (n.start, n.end)):
            if stack[-1].logit >= n.logit:
                stay = False
                break
            stack.pop().start = -1
        if stay:
            stack.append(n)
            kept.append(n)
    return [n for n in kept if n.start >= 0]


def decode(nodes: list[Node]) -> list[Node]:
    """Switch on the consistent set of nodes with the highest total log-odds.

    Of two nodes that cross or share a span, the likelier stays. Over the rest, which is a
    forest, the best choice is found bottom-up: a literal node (code, comment, formula)
    that is on forces off what may not stand inside it, so no descendant contradicts an
    ancestor. Neither pass recurses, so deep nesting is no problem.
    """
    alive = _without_conflicts([n for n in nodes if n.logit > 0])
    roots: list[Node] = []
    stack: list[Node] = []
    for n in alive:
        n.children = []
        while stack and stack[-1].end <= n.start:
            stack.pop()
        (stack[-1].children if stack else roots).append(n)
        stack.append(n)

    def inside(n: Node, context: str | None) -> str | None:
        own = _allowed(n)
        return context if own is None else own if context is None or own == context else ""

    best: dict[int, dict[str | None, tuple[float, bool]]] = {}
    for n in reversed(alive):
        mine = best[id(n)] = {}
        for context in _CONTEXTS:
            off = sum(best[id(c)][context][0] for c in n.children)
            if context is not None and n.kind[0] not in context:
                mine[context] = (off, False)
                continue
            within = inside(n, context)
            on = n.logit + sum(best[id(c)][within][0] for c in n.children)
            mine[context] = (on, True) if on >= off else (off, False)
    chosen: list[Node] = []
    todo: list[tuple[Node, str | None]] = [(r, None) for r in roots]
    while todo:
        n, context = todo.pop()
        n.on = best[id(n)][context][1]
        if n.on:
            chosen.append(n)
        within = inside(n, context) if n.on else context
        todo += [(c, within) for c in n.children]
    return sorted(chosen, key=lambda n: (n.start, -n.end))
