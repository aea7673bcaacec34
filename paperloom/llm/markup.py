"""Problem 6: markup residue in text fields.

Candidate nodes of a tolerant parse are judged by gradient-boosted trees over their
features, and a hierarchical decoding picks a consistent set. The classifier is fitted on
texts generated here, in which every construct and every look-alike is labelled; their
number is the parameter ``TRAIN_TEXTS``. Neither rows nor phrases of the data are used.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import dom
from paperloom.llm.boosting import Boosted, fit
from paperloom.runtime import ship

#: Generated training texts; the fit takes a few seconds on the driver.
TRAIN_TEXTS, SEED = 3000, 7
#: Parts the families are cut into to measure what a held-out part costs.
FOLDS = 5


class _Maker:
    """Random sentences and labelled constructs."""

    def __init__(self, seed: int, fold: int | None = None, held_out: bool = False):
        """With ``fold`` the families of constructs and look-alikes of that number modulo
        ``FOLDS`` are left out, or with ``held_out`` are the only ones."""
        self.r, self.fold, self.held_out = random.Random(seed), fold, held_out

    def pick(self, families: list) -> Callable:
        """One of the families in use."""
        if self.fold is not None:
            families = [f for i, f in enumerate(families) if (i % FOLDS == self.fold) == self.held_out]
        return self.r.choice(families)

    def word(self) -> str:
        r = self.r
        if r.random() < 0.45:
            return r.choice("the of a in we for with is and results data model given method large small when this under both it study case order error mean".split())
        return "".join(r.choice("b d f g k l m n p r s t v z br st tr pl gr".split()) + r.choice("aeiouy") for _ in range(r.randint(1, 4))) + r.choice(["", "", "s", "n", "rd", "ing"])

    def words(self, a: int = 1, b: int = 3) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def number(self) -> str:
        r = self.r
        return r.choice([str(r.randint(1, 400)), f"{r.randint(0, 9)}.{r.randint(1, 99)}"])

    def sentence(self) -> str:
        w = self.words(5, 14).split()
        if self.r.random() < 0.3:
            w.insert(self.r.randint(1, len(w)), self.number())
        w[0] = w[0].capitalize()
        return " ".join(w) + self.r.choice([".", ".", ".", ":", "!", "?"])

    def formula(self) -> str:
        r, n = self.r, self.number()
        x = r.choice("abfghkmnpqtuvwxyzABCEGHNRTX")
        return r.choice([
            x, "\\alpha", f"\\{r.choice(['alpha', 'beta', 'sigma', 'lambda', 'mu', 'omega'])}", f"{x}_{{{r.choice('ijkn')}}} \\le {n}", f"O({x}^{{2}})",
            f"O({x} \\log {x})", f"\\sum_{{k=1}}^{{n}} {x}_k", f"\\frac{{a}}{{b+{n}}}", f"\\sqrt{{{n}}}\\,\\sigma", f"{x} = {r.choice('hkmn')}\\nu",
            f"f({x})=0", f"{x}^2", f"{x}_0", f"{x}+{n}", f"{x} > {n}", f"{n}", f"10^{{{n}}}", f"p < {n}", f"\\int_0^1 {x} d{x}", f"\\mathcal{{{x}}}", f"({x},{r.choice('yzt')})", f"N={n}"])

    def code(self) -> str:
        r, w = self.r, re.sub(r"\W", "", self.word()) or "x"
        return r.choice([
            f"for i in range({self.number()}):\n    {w}[i] += 1", f'{w} = load("{w}.bin")\nprint(len({w}))', f"while ({w}.next()) {{ n = n + 1; }}",
            f"select count(*) from {w} where df > {self.number()}", f"if a < b and b > c:\n    {w}_max_len = 2**8  # {w}", f"x = {w}['a'] # ''{w}''\ny = x[[1, 2]]",
            f"echo $HOME; ls *.txt\n# {w}", f"#include <{w}.h>\nint {w}(int a) {{ return a * 2; }}", f"<b>{w}</b> &amp; $x$", f"**{w}** and [[{w}]]"])

    def construct(self) -> tuple[str, str, bool]:
        """(text, languages as initials, whether it takes lines of its own)."""
        r, w, f, n, words = self.r, self.word, self.formula, self.number, self.words
        env = r.choice(["equation", "align", "displaymath", "eqnarray*", "equation*"])
        tag = r.choice("i b em strong sub sup u tt span small a code p jats:italic jats:bold jats:sup mark cite".split())
        attr = r.choice(["", "", f' class="{w()}"', f" href='/{w()}/{n()}'", f' href="/{w()}" target=_blank', f' style="color:{w()}"'])
        block = r.choice("p jats:p li h1 h2 h3 h4 div blockquote td jats:title title".split())
        items = lambda mark, inner: "\n".join(f"{mark} {inner()}" for _ in range(r.randint(1, 4)))
        ent = r.choice("nbsp amp lt gt mdash ndash ldquo rdquo rsquo lsquo eacute ouml alpha hellip times".split() + ["#8211", "#x3B1", "#8217", "#39"])
        bold = r.choice(["**{}**", "__{}__"])
        return self.pick([
            lambda: (f"<{tag}{attr}>{words(1, 4)}</{tag}>", "h", False),
            lambda: (f"<{tag}{attr}>{words(1, 4)}", "h", False),
            lambda: (f"{words(1, 2)}</{tag}>", "h", False),
            lambda: (f"{w()}<{r.choice(['sup', 'sub'])}>{n()}</{r.choice(['sup', 'sub'])}>", "h", False),
            lambda: (r.choice(["<br>", "<br/>", "<br />", "<hr>", f'<img src="{w()}.png" />', f'<img src="{w()}.png">']), "h", False),
            lambda: (f"<{block}>{self.sentence()}</{block}>", "h", r.random() < 0.5),
            lambda: ("<ul>" + "".join(f"<li>{words()}</li>" for _ in range(r.randint(1, 4))) + "</ul>", "h", True),
            lambda: (f"<table><tr><th>{w()}</th><th>{words()}</th></tr><tr><td>{n()}</td><td>{n()}</td></tr></table>", "h", True),
            lambda: (f"<pre><code>{self.code()}</code></pre>", "h", True),
            lambda: (f"<!-- {words(1, 4)} -->", "h", False),
            lambda: (f"&{ent};", "h", False),
            lambda: (f"{w()}&{ent};{w()}", "h", False),
            lambda: (f"&lt;{block}&gt;{self.sentence()}&lt;/{block}&gt;", "h", r.random() < 0.5),
            lambda: (f"&lt;{tag}&gt;{words()}&lt;/{tag}&gt;", "h", False),
            lambda: (f"${f()}$", "t", False), lambda: (f"${f()}$-{w()}", "t", False), lambda: (f"${f()}$", "t", False), lambda: (f"${f()}${r.choice(',.;')}", "t", False),
            lambda: (f"\\({f()}\\)", "t", False), lambda: (f"\\[{f()}\\]", "t", r.random() < 0.5), lambda: (f"$${f()}$$", "t", r.random() < 0.5),
            lambda: (f"\\begin{{{env}}}{r.choice(['', f'\\label{{eq:{w()}}}'])}\n{f()}\n\\end{{{env}}}", "t", True),
            lambda: ("\\begin{itemize}\n" + items("\\item", words) + "\n\\end{itemize}", "t", True),
            lambda: (f"\\begin{{{r.choice(['verbatim', 'lstlisting'])}}}\n{self.code()}\n\\end{{verbatim}}".replace("lstlisting", "verbatim"), "t", True),
            lambda: (f"\\begin{{{r.choice(['abstract', 'quote', 'theorem', 'center'])}}}\n{self.sentence()}", "t", True),
            lambda: (f"\\{r.choice(['emph', 'textbf', 'textit', 'texttt', 'textsc', 'underline', 'footnote', 'mbox', 'textrm'])}{{{words(1, 3)}}}", "t", False),
            lambda: (f"{{\\{r.choice(['it', 'em', 'bf', 'tt', 'sc'])} {words(1, 3)}{r.choice(['', chr(92) + '/'])}}}", "t", False),
            lambda: (f"\\{r.choice(['section', 'section*', 'subsection', 'paragraph'])}{{{words(1, 3)}}}", "t", r.random() < 0.6),
            lambda: (f"{w()}~\\{r.choice(['cite', 'ref', 'citep', 'eqref'])}{{{w()}{n()}}}", "t", False),
            lambda: (f"{w()}\\{r.choice(['ss{}', 'v{c}', 'o{}', 'c{c}', 'ae{}'])}{w()}", "t", False),
            lambda: (f"{w()}\\{r.choice(['ss', 'o', 'l', 'ldots', 'dots'])}{{}} {w()}", "t", False),
            lambda: (r.choice([f"{w()}\\'{{e}}{w()}", f"{w()}\\\"o{w()}", f"{w()}\\'e", f"{w()}\\~n{w()}", f"{w()}\\^{{\\i}}{w()}"]), "t", False),
            lambda: (r.choice([f"{n()}\\%", f"{w()} \\& {w()}", f"\\#{n()}", f"{w()}\\_{w()}", f"\\${n()}"]), "t", False),
            lambda: (f"\\{r.choice(['alpha', 'sigma', 'lambda', 'mu'])} {w()}", "t", False),
            lambda: (f"{'#' * r.randint(1, 4)} {words(1, 5).capitalize()}", "m", True), lambda: (f"# {words(2, 5).capitalize()}", "m", True),
            lambda: (f"{'#' * r.randint(1, 4)} {r.choice(['Aim', 'Results', 'Methods', 'Data', w().capitalize()])}\n", "m", True), lambda: (f"# {r.choice([f'[{w()}](/{w()}/{n()})', bold.format(w()), f'`{w()}`', w()])} {words(2, 4)}\n", "m", True),
            lambda: ((h := words(1, 3).capitalize()) + "\n" + r.choice("=-") * max(3, len(h)), "m", True),
            lambda: (bold.format(words(1, 3)), "m", False), lambda: (bold.format(w()), "m", False),
            lambda: (r.choice(["*{}*", "_{}_"]).format(words(1, 3)), "m", False),
            lambda: (f"`{r.choice([w(), w() + '_' + w(), w() + '()', 'Q&A', 'and', 'R&D', 'a<b', '$HOME'])}`", "m", False),
            lambda: (f"```{r.choice(['', 'python', 'text', 'sql'])}\n{self.code()}\n```", "m", True),
            lambda: (f"[{words(1, 2)}](/{w()}/{n()}{r.choice(['', f' {chr(34)}{w()}{chr(34)}'])})", "m", False),
            lambda: (f"![{w()}]({w()}.png)", "m", False), lambda: (f"[{w()}](https://{w()}.org/{w()})", "m", False),
            lambda: (items("-", lambda: r.choice([words(1, 4), bold.format(words(1, 3))])), "m", True),
            lambda: (items(r.choice(["*", "+"]), lambda: bold.format(words(1, 3))), "m", True),
            lambda: ("\n".join(f"{i + 1}. {r.choice([words(1, 4), bold.format(words(1, 3))])}" for i in range(r.randint(2, 4))), "m", True),
            lambda: (f"> {r.choice(['', bold.format('Note:') + ' '])}{self.sentence()}", "m", True),
            lambda: (f"| {w()} | {words()} |\n|---|{r.choice(['---', ':---:', '---:'])}|\n| {n()} | {n()} |", "m", True),
            lambda: (f"~~{words(1, 2)}~~", "m", False),
            lambda: ((e := "=" * r.randint(2, 4)) + f" {words(1, 3).capitalize()} " + e, "w", True),
            lambda: ((q := "'" * r.choice([2, 3])) + words(1, 2) + q, "w", False), lambda: ((q := "'" * r.choice([2, 3, 5])) + w() + q, "w", False),
            lambda: (f"[[{words(1, 2)}]]", "w", False), lambda: (f"[[{w()} ({w()})|{w()}]]", "w", False), lambda: (f"[[#{w().capitalize()}|{w()}]]", "w", False),
            lambda: (f"[[{r.choice(['Category', 'File', 'Image'])}:{words(1, 3)}]]", "w", r.random() < 0.5),
            lambda: (f"{{{{{w()}|{w()}|{w()}}}}}", "w", False), lambda: (f"{{{{cite {w()}|title={w()}|year={r.randint(1960, 2020)}}}}}", "w", False), lambda: (f"{{{{{w()}}}}}", "w", False),
            lambda: (f'{{| class="{w()}"\n! {w()} !! {words()}\n|-\n| {n()} || {n()}\n|}}', "w", True),
            lambda: (items(r.choice(["*", "**", "#", ":"]), lambda: r.choice([f"[[{words(1, 3)}]]", f"'''{w()}''' {w()}"])), "w", True),
            lambda: (f"=== {words(1, 2)} ===\n" + items(r.choice("*#"), lambda: r.choice([f"[[{words(1, 3)}]]", words(2, 4)])), "w", True),
            lambda: (f"[https://{w()}.org/{w()} {words(1, 2)}]", "w", False), lambda: (r.choice(["__NOTOC__", "__TOC__", "~~~~"]), "w", r.random() < 0.5),
        ])()

    def lookalike(self) -> tuple[str, str, bool]:
        """Text that only holds the same characters: its families are kinds of signs in another
        role, filled with random words, letters and numbers."""
        r, w, n, words = self.r, self.word, self.number, self.words
        k = lambda: str(r.randint(2, 300))
        v, big = lambda: r.choice("abcdefghijkmnpqrstuvwxyz"), lambda: r.choice("ABCDEFGHIJKLMNPQRSTVWXYZ")
        some = lambda *xs: r.choice(xs)
        name = lambda: "".join(big() for _ in range(r.randint(3, 6)))
        part = lambda: re.sub(r"\W", "", w()) or "x"
        if r.random() < 0.85:
            return self.pick([
                # prices
                lambda: f"{words()} ${k()} {words()}, {words()} ${k()}", lambda: f"{words()} ${n()}", lambda: f"${n()} {some('and', 'or', 'to')} ${n()} {words()}", lambda: f"{some('US', 'A', 'C')}${k()}-${k()}",
                # powers and products
                lambda: f"{words()} {k()}**{r.randint(2, 9)} {words()}", lambda: f"{r.randint(2, 9)}**{k()} {some('and', 'plus')} {r.randint(2, 9)}**{k()}", lambda: f"{k()} * {k()} = {k()}", lambda: f"{words()} {r.randint(2, 9)} * {r.randint(2, 9)} = {k()} {w()} {some('and', 'or')} {r.randint(2, 9)} * {r.randint(2, 9)} = {k()}",
                # stars as names, keys and marks of significance
                lambda: f"{words()} {big()}* {words()}", lambda: f"{big()}* {some('and', 'or')} {big()}* {words()}", lambda: f"{w()} (* = {w()}) {some('and', 'with')} * {w()} {words()}", lambda: f"(* = {words()}, ** = {w()})", lambda: f"{words()} (* = {w()})", lambda: f"{w()}* and {w()}* {w()}", lambda: f"*p < {n()}, **p < {n()}",
                # comparisons
                lambda: f"{words()} {v()}<{v()} {some('and', 'or')} {v()}>{v()} {w()}", lambda: f"{words()} {v()} < {n()} and {v()} > {k()} {w()}", lambda: f"{v()}<{v()} {some('or', 'and')} {v()}>{k()}", lambda: f"{some('if', 'when')} {k()} < {v()} {w()} {v()} > {k()}", lambda: f"{v()}<{v()}, {v()}>{v()}", lambda: f"<{n()}> {some('and', 'or')} <{k()}", lambda: f"{v()} <= {v()} and {v()} >= {v()}", lambda: f"{v()} < {v()} > {v()}",
                lambda: f"{v()}: {big()} -> {big()} {words()} {big()} <= {big()}", lambda: f"{w()} -> {w()} => {w()}", lambda: f"{words()} {v()} > {v()} and {v()} > {v()} {w()} {v()} > {v()}",
                # paths and names of the system
                lambda: f"{some(*'CDEF')}:\\{part()}\\{part()}", lambda: f"{words()} {some(*'CDE')}:\\{part()}\\{part()} {words()}", lambda: f"{some(*'DEF')}:\\{part()}\\{part()}\\{part()}", lambda: f"\\\\{part()}\\{part()}", lambda: f"{words()} /{part()}/{part()}.{part()} {words()}",
                lambda: f"{words()} ${name()} {words()}", lambda: f"${name()} {some('and', 'or')} ${name()}", lambda: f"../{part()}/{part()}.txt {words()} ${name()}", lambda: f"{part()}/*.{part()}",
                # brackets and braces
                lambda: f"{w()} [{k()}] and [{r.randint(1, 9)}, {r.randint(1, 9)}] {w()}", lambda: f"[{k()}], [{k()}]", lambda: f"{words()} [[{n()}, {n()}], [{n()}, {k()}]] {w()}", lambda: f"[[0, {k()}], [{n()}, 1], [{n()}, 0]]", lambda: f"{part()}[{r.randint(0, 9)}][{r.randint(0, 9)}]", lambda: f"[{w()}] ({w()})", lambda: f"{words()} [0, {n()}) or ({n()}, 1]",
                lambda: f"{words()} {{{v()}, {v()}, {v()}}} {words()} & {words()}", lambda: f"{{{{{k()}, {k()}}}, {{{k()}}}}}", lambda: f"{{{k()}, {k()}}} {w()}",
                # underscores
                lambda: f"{words()} {part()}_{part()}_{part()} {words()}", lambda: f"{part()}_{part()} and {part()}_{part()}", lambda: f"{v()}_{v()} and {v()}_{v()}", lambda: f"_{part()} and {part()}_", lambda: f"__{part()}__ {words()}" if r.random() < 0.3 else f"{part()}_1 and {part()}_2",
                # ampersands
                lambda: f"{big()}&{big()} {w()} {some('and', 'or')} {big()}&{big()} {w()}", lambda: f"{words()} {big()}&{big()}; {words()}", lambda: f"{big()}{big()}&{big()}; {w()} & {w()}", lambda: f"{big()}&{big()}; {w()}", lambda: f"{part()}&{part()}; {w()}", lambda: f"{w().capitalize()} & {w()} {words()}",
                # signs of numbering, dashes and ratios
                lambda: f"{w()} #{k()} {words()}", lambda: f"{big()}# and {big()}#", lambda: "#1 and #2", lambda: f"{words()} {v()}/{v()} -- {w()} {v()}/{v()} -- {w()} {n()}", lambda: f"{words()} - {w()} {w()} - {words()}", lambda: f"{words()} ~{k()} {w()}", lambda: f"{k()}~{k()} {w()}",
                # primes and quotes
                lambda: f"{v()}''({v()}) and {v()}''({v()})", lambda: f"{n()}'' and {n()}'' {w()}", lambda: f"''{w()}" if r.random() < 0.2 else f"{w()}' and {w()}'", lambda: f'"{words()}"', lambda: "don't, can't and it's", lambda: f"`{w()} and '{w()}'" if r.random() < 0.5 else f"{w()} `{w()}' {w()}",
                # equal signs, bars and the rest
                lambda: f"{v()} == {v()} and {v()} == {v()}", lambda: f"{v()} = {v()} == {v()}", lambda: f"|{v()}| < {n()} and |{v()}| > {n()}", lambda: f"{big()}({v()}|{v()}) and {big()}({v()}|{v()})", lambda: f"{w()} | {w()}", lambda: f"({k()}) {w()}; ({v()}) {w()}", lambda: f"{k()}% {words()}", lambda: f"10^{k()} and 2^{v()}", lambda: f"e-mail {part()}@{part()}.org", lambda: f"{v()}_1, ..., {v()}_{v()}",
            ])(), "", False
        return self.pick([
            lambda: f"- {n()} {words()}", lambda: f"{k()}. {w()}" if r.random() < 0.3 else f"{k()}) {w()}", lambda: f"> {n()} {words()}" if r.random() < 0.5 else f"< {n()} {words()}", lambda: f"#{k()} {words()}", lambda: f"* = {w()}", lambda: f"= {n()} {words()}", lambda: f"-- {words(2, 3)}", lambda: f"$ {k()} {words()}",
        ])(), "", True

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text and its marked spans (start, end, language initials)."""
        r = self.r
        out, marks, at = [], [], 0

        def put(x: str, langs: str | None = None) -> None:
            nonlocal at
            if langs:
                marks.append((at, at + len(x), langs))
            out.append(x)
            at += len(x)

        title = r.random() < 0.3
        for i in range(1 if title else r.randint(1, 7)):
            if i:
                put(r.choice([" ", " ", "\n", "\n\n"]))
            x = r.random()
            if title:
                ws = self.words(3, 9).split()
                cut = r.randint(0, len(ws))
                if x > 0.93:
                    inner = r.choice([self.word(), f"**{self.word()}**", f"__{self.word()}__", f"`{self.word()}`", f"[{self.word()}](/{self.word()}/{self.number()})"])
                    put(f"{'#' * r.choice([1, 1, 1, 2])} {' '.join(ws[:cut])} {inner} {' '.join(ws[cut:])}".replace("  ", " ").strip(), "m")
                    continue
                put(" ".join(ws[:cut]).capitalize() + (" " if cut else ""))
                if x < 0.85:
                    c, langs, _ = self.construct() if x < 0.5 else self.lookalike()
                    put(c, langs)
                put((" " if cut < len(ws) else "") + " ".join(ws[cut:]))
                continue
            if x < 0.25:
                put(self.sentence())
                continue
            if x < 0.45:  # a block that holds elements of any language
                before, after, langs, own = r.choice((
                    ("<p>", "</p>", "h", False), ("<p>", "</p>", "h", True), ("<jats:p>", "</jats:p>", "h", False), ("&lt;p&gt;", "&lt;/p&gt;", "h", True), ("<li>", "</li>", "h", False),
                    ("<i>", "</i>", "h", False), ("> ", "", "m", True), ("- ", "", "m", True), ("\\item ", "", "t", True), ("\\begin{quote}\n", "\n\\end{quote}", "t", True), ("* [[", "]]", "w", True)))
                if own and out and not out[-1].endswith("\n"):
                    put("\n")
                first = at
                put(before)
                if before != "* [[":
                    put(self.words(1, 5).capitalize() + " ")
                    for _ in range(r.randint(1, 2)):
                        c, inner, lines = self.construct() if r.random() < 0.6 else self.lookalike()
                        if lines:
                            c, inner = self.words(1, 3), None
                        put(c, inner)
                        put(" " + self.words(1, 4) + " ")
                else:
                    put(self.words(1, 3))
                put(after)
                marks.append((first, at, langs))
                if own:
                    put("\n")
                continue
            if x < 0.53:  # a section: a heading, perhaps a list, and text with anything in it
                if out and not out[-1].endswith("\n"):
                    put("\n")
                head = r.choice(["Aim", "Results", "Methods", "Data", "Outlook", "Background", "Data and code", self.words(1, 3).capitalize()])
                if r.random() < 0.6:
                    put(f"{'#' * r.randint(1, 4)} {head}", "m")
                    put("\n\n")
                else:
                    e = "=" * r.randint(2, 4)
                    put(f"{e} {head} {e}", "w")
                    put("\n")
                    for _ in range(r.choice([0, 1, 2, 3])):
                        put(f"{r.choice('**#')} {r.choice(['[[{}]]', '[[{}]]', '{}'])}".format(self.words(2, 4)), "w")
                        put("\n")
                put(self.sentence() + " " + self.words(2, 5).capitalize() + " ")
                c, inner, lines = self.construct() if r.random() < 0.5 else self.lookalike()
                if not lines:
                    put(c, inner)
                put(" " + self.words(1, 4) + r.choice([". ", ".\n\n"]))
                continue
            c, langs, own = self.construct() if x < 0.77 else self.lookalike()
            if own:
                if out and not out[-1].endswith("\n"):
                    put(r.choice(["\n", "\n\n"]))
                put(c, langs)
                put(r.choice(["\n", "\n\n"]))
            else:
                put(self.words(2, 6).capitalize() + r.choice([" ", " ", " ", ", ", " ("]))
                put(c, langs)
                put(r.choice([" ", " ", ", ", ". ", ") "]) + self.words(2, 6) + ".")
        return "".join(out), marks


def training_rows(texts: int = TRAIN_TEXTS, seed: int = SEED, fold: int | None = None, held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidate nodes of generated texts. A node is real if a
    marked span of its language holds it and it does not stand in that span's code. For
    ``fold`` and ``held_out`` see ``_Maker``."""
    make, rows, labels = _Maker(seed, fold, held_out), [], []
    for _ in range(texts):
        text, marks = make.text()
        nodes = dom.parse(text)
        rows += dom.features(text, nodes)
        for n in nodes:
            labels.append(float(any(s <= n.start and n.end <= e and n.kind[0] in langs for s, e, langs in marks)))
    return np.array(rows), np.array(labels)


@lru_cache(maxsize=1)
def model() -> Boosted:
    """The fitted classifier; made once per driver process and the same every time."""
    return fit(*training_rows())


def judged(texts: list[str | None], trees: Boosted) -> list[list[dom.Node]]:
    """The nodes that are markup, per text; scores of all texts are computed at once."""
    parsed = [dom.parse(t) if t else [] for t in texts]
    rows = [r for t, nodes in zip(texts, parsed) if nodes for r in dom.features(t, nodes)]
    if rows:
        scores = iter(trees.logits(np.array(rows)))
        for nodes in parsed:
            for n in nodes:
                n.logit = float(next(scores))
    return [dom.decode(nodes) if nodes else [] for nodes in parsed]


_BLOCK_TAGS = set("p div li tr table ul ol blockquote pre section article h1 h2 h3 h4 h5 h6 br hr title jats:p jats:title".split())
_TEX_SIGNS = {"\\%": "%", "\\&": "&", "\\$": "$", "\\#": "#", "\\_": "_", "\\{": "{", "\\}": "}", "\\,": " ", "\\;": " ", "\\:": " ", "\\ ": " ", "\\/": "", "\\!": "", "\\-": "", "\\\\": "\n", "\\@": "", "\\|": "|"}
_ARGS = re.compile(r"\{([^{}]*)\}")
_TEX_LETTERS = {"ss": "\u00df", "o": "\u00f8", "O": "\u00d8", "l": "\u0142", "L": "\u0141", "ae": "\u00e6", "AE": "\u00c6", "oe": "\u0153", "aa": "\u00e5", "i": "\u0131"}
_COMBINING = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "v": "\u030c", "c": "\u0327", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a", "b": "\u0331", "d": "\u0323", "t": "\u0361"}


def _formula(x: str) -> str:
    return f"${x.strip()}$"


def _render_one(n: dom.Node, raw: str, inner: str) -> str:
    """Clean form of one node: ``raw`` is its source, ``inner`` its cleaned content."""
    import html
    import unicodedata

    k, name = n.kind, n.name.rstrip("*")
    if k == "h_comment":
        return ""
    if k == "h_entity":
        return html.unescape(raw).replace("\xa0", " ")
    if k == "h_escaped":
        tag = re.match(r"&lt;(/?)([\w:.-]*)", raw)
        local = tag[2].lower().split(":")[-1] if tag else ""
        if tag and not tag[1] and re.fullmatch("h[1-6]|title", local):
            return "\n# "
        return "\n- " if tag and local == "li" and not tag[1] else "\n" if tag and tag[2].lower() in _BLOCK_TAGS else ""
    if k == "h_tag":
        return "\n- " if name == "li" else "\n" if name in _BLOCK_TAGS else ""
    if k == "h_element":
        local = name.split(":")[-1]
        if re.fullmatch("h[1-6]|title", local):
            return f"\n{'#' * int(local[1]) if local[1:].isdigit() else '#'} {inner.strip()}\n"
        if local == "li":
            return f"\n- {inner.strip()}"
        if local == "pre":
            return f"\n```\n{inner.strip()}\n```\n"
        if local == "code":
            return inner if "\n" in inner or (n.parent and n.parent.on and n.parent.name == "pre") else f"`{inner}`"
        if local in ("td", "th"):
            return f"{inner.strip()} | "
        if local in ("script", "style"):
            return ""
        return f"\n{inner}\n" if name in _BLOCK_TAGS else inner
    if k == "t_env":
        if name in dom.MATH_ENVS:
            return f"\n$${re.sub(r'\\label{[^{}]*}', '', raw[raw.index('}') + 1 : raw.rindex(chr(92) + 'end')]).strip()}$$\n"
        if name in dom.VERBATIM:
            return f"\n```\n{inner.strip()}\n```\n"
        return f"\n{inner.strip()}\n"
    if k == "t_halfenv":
        return "\n"
    if k in ("t_display", "t_inline"):
        return _formula(raw[2:-2])
    if k == "t_dollars":
        return _formula(raw[2:-2])
    if k == "t_dollar":
        return _formula(raw[1:-1])
    if k == "t_symbol":
        if raw in _TEX_SIGNS:
            return _TEX_SIGNS[raw]
        letter = raw[2:].strip("{}\\")
        return unicodedata.normalize("NFC", letter + _COMBINING.get(raw[1], "")) if letter else ""
    if k == "t_group":
        return inner.strip()
    if k == "t_command":
        if name in ("section", "subsection", "subsubsection", "chapter", "paragraph", "title"):
            return f"\n{'##' if name.startswith('sub') else '#'} {' '.join(_ARGS.findall(raw)).strip()}\n"
        if name == "item":
            return "\n- "
        if name in ("label", "vspace", "hspace", "usepackage", "documentclass", "includegraphics"):
            return ""
        if name in ("cite", "citep", "citet", "ref", "eqref"):
            return f"[{' '.join(_ARGS.findall(raw))}]"
        if name in ("footnote",):
            return f" ({' '.join(_ARGS.findall(raw))})"
        args = " ".join(_ARGS.findall(raw))
        if name in _TEX_LETTERS and not args:
            return _TEX_LETTERS[name]
        if name in _COMBINING and len(args) == 1:
            return unicodedata.normalize("NFC", args + _COMBINING[name])
        return args if "{" in raw else "..." if name in ("ldots", "dots") else "" if name in ("it", "em", "bf", "tt", "sc", "rm", "sf", "noindent", "centering", "par") else f"${raw}$"
    if k == "m_heading":
        return re.sub(r"[ \t#]+$", "", raw.lstrip())
    if k == "m_setext":
        head, line = raw.rsplit("\n", 1)
        return f"{'#' if '=' in line else '##'} {head.strip()}"
    if k in ("m_bold", "m_bold_", "m_strike"):
        return inner
    if k in ("m_italic", "m_italic_"):
        return inner.strip()
    if k == "m_code":
        return raw
    if k == "m_link":
        text = re.match(r"!?\[([^\]]*)\]", raw)
        return text[1] if text else raw.strip("<>")
    if k in ("m_item", "m_number", "m_fence", "m_table"):
        return raw if k in ("m_fence", "m_table") else inner
    if k == "m_quote":
        return re.sub(r"^ {0,3}>[ \t]?", "", inner)
    if k == "m_rule":
        return ""
    if k == "w_heading":
        m = re.match(r"(=+)\s*(.*?)\s*=+\s*$", raw, re.S)
        return f"{'#' * max(1, len(m[1]) - 1)} {m[2]}"
    if k == "w_quotes":
        return inner.strip("'")
    if k == "w_link":
        target, _, shown = raw[2:-2].rpartition("|")
        return "" if re.match(r"(?i)(category|file|image):", raw[2:]) else shown if target or "|" in raw else raw[2:-2].lstrip("#:")
    if k == "w_template":
        parts = raw[2:-2].split("|")
        return parts[-1] if len(parts) > 1 and "=" not in parts[-1] else ""
    if k == "w_table":
        cells = [c.strip() for line in raw.split("\n")[1:-1] if not line.startswith("|-") for c in [" | ".join(x.strip() for x in re.split(r"\|\||!!", line.lstrip("!|")))]]
        return "\n" + "\n".join(cells) + "\n"
    if k == "w_item":
        mark = re.match(r"[*#:;]+", raw)[0]
        return ("- " if mark[-1] in "*#" else "") + inner[len(mark):].strip() if inner.startswith(mark) else inner
    if k == "w_external":
        return raw[1:-1].partition(" ")[2] or raw[1:-1]
    return ""


def render(text: str | None, on: list[dom.Node]) -> str | None:
    """Clean text: headings as ``# …`` lines, list items as ``- …``, code in back quotes or
    fences, formulas in dollars; everything else unmarked. Null stays null."""
    if text is None:
        return None
    if not on:
        return text
    ends: dict[int, str] = {}
    for n in reversed(on):  # inner nodes come after outer ones, so contents are ready
        inside = [c for c in n.children if c.on] if n.children else []
        a, b = (n.body if n.kind in ("h_element", "t_env") else (n.start, n.end))
        strip = {"m_bold": 2, "m_bold_": 2, "m_strike": 2, "m_italic": 1, "m_italic_": 1, "w_quotes": 2, "t_group": 1}.get(n.kind, 0)
        a, b = a + strip, b - strip
        parts, at = [], a
        for c in inside:
            if c.start >= at and c.end <= b:
                parts += [text[at : c.start], ends[id(c)]]
                at = c.end
        parts.append(text[at:b])
        ends[id(n)] = _render_one(n, text[n.start : n.end], "".join(parts))
    out, at = [], 0
    for n in on:
        if n.start >= at:
            out += [text[at : n.start], ends[id(n)]]
            at = n.end
    out.append(text[at:])
    clean = "".join(out)
    clean = clean.replace("~[", " [")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", clean)).strip()


def _run(trees: Boosted, key: str, fields: list[str], make: Callable[[str | None, list[dom.Node]], list[str | None]]):
    def run(batches):
        for b in batches:
            keys, names, values = [], [], []
            ids = b.column(key).to_pylist()
            for f in fields:
                texts = b.column(f).to_pylist()
                for i, t, nodes in zip(ids, texts, judged(texts, trees)):
                    for v in make(t, nodes):
                        keys.append(i), names.append(f), values.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.schema.field(key).type), pa.array(names, pa.string()), pa.array(values, pa.string())], [key, "field", "value"])

    return run


def _languages(_: str | None, on: list[dom.Node]) -> list[str | None]:
    return [dom.LANGUAGE[x] for x in sorted({n.kind[0] for n in on})]


def _cleaned(t: str | None, on: list[dom.Node]) -> list[str | None]:
    return [render(t, on)]


def _mapped(df: DataFrame, key: str, fields: list[str], make) -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *fields).mapInArrow(_run(model(), key, fields, make), f"`{key}` {kind}, field string, value string")


def find_markup(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, markup): one row for each markup language a field holds an element of.

    Whole fields are parsed, a batch at a time, without a shuffle. Null, empty and plain
    texts have no row; repeated rows count each; other columns are not read.
    """
    return _mapped(df, key, fields, _languages).withColumnRenamed("value", "markup")


def clean_markup(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, clean): each field as clean text with its structure; see ``render``."""
    return _mapped(df, key, fields, _cleaned).select(F.col(key), "field", F.col("value").alias("clean"))
