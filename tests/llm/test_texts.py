"""BPE, markup, names and residue."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, dom, markup, names, residue

P = pytest.importorskip("public_tokenizers")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = ["", "Hello world", "  a\n\n b\t", "naïve日本🙂", "<|endoftext|>", "don't we'll", "x" * 30000, "ab" * 20000, " " * 5000, "\x00\x1c\u0085\u200b", "1234567890 ½²"]


def test_bpe_equals_library(reference):
    enc = bpe.load()
    r = random.Random(5)
    alphabet = ["a", "e", "th", " ", "  ", "\n", "'s", "é", "日", "🙂", "1", "_", "\u00a0", "\u0301", "ß"]
    for t in TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(500)]:
        assert enc.encode(t) == reference(t), ascii(t[:40])


def test_bpe_without_known_whole_words():
    """Merges alone, without the whole-word shortcut, give the same ids."""
    enc = bpe.load()
    for w in (" international", "aaaaaaaaaaaa", " Strömung"):
        piece = w.encode()
        whole = enc.ranks.pop(piece, None)
        try:
            split = enc.merge(piece)
        finally:
            if whole is not None:
                enc.ranks[piece] = whole
        assert b"".join(enc.bytes_of[i] for i in split) == piece


def test_rank_queue():
    q = bpe.RankQueue(50_000)
    for rank, pos in ((4096, 3), (7, 9), (7, 2), (49_999, 1)):
        q.push(rank, pos)
    assert q.first() == 7 and q.take(7) == [2, 9] and q.first() == 4096
    q.take(4096), q.take(49_999)
    assert q.first() == -1


def test_encode_frame(spark, reference):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate([*TEXTS, None])}
    assert bpe.encode(df.limit(0)).count() == 0
    assert {r["n_tokens"] for r in bpe.count_tokens(df.filter("text is null"), ["doc_id"]).collect()} == {0}


MARKUP = [
    ("How <em>continuous</em> is it", {"html"}), ("a &ldquo;word&rdquo; here", {"html"}), ("<p>One.</p>\n<p>Two.</p>", {"html"}), ("end.<!-- draft -->", {"html"}),
    ("On &lt;i&gt;the&lt;/i&gt; case", {"html"}), ("Residual <b>grammar with it", {"html"}),
    ("A $k$-means and \\(p\\)-test", {"latex"}), ("{\\it The} wave", {"latex"}), ("up to 83\\% of it", {"latex"}), ("see~\\cite{ab99} and \\ss{}", {"latex"}),
    ("as seen.\n\\begin{equation}\\label{eq:a}\nx_{i} \\le 2\n\\end{equation}", {"latex"}),
    ("# On the **bold** case", {"markdown"}), ("### Aim\n\nThis is it.", {"markdown"}), ("text\n\n```python\nfor i in x:\n    y = a[[1]] # ''q''\n```", {"markdown"}),
    ("a [link](/abs/12) in it", {"markdown"}), ("so.\n\n- **the one**\n- **the two**\n\nEnd.", {"markdown"}), ("x.\n\n| n | m |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("with `code` in it", {"markdown"}),
    ("[[the (term)|the]] wave", {"wiki"}), ("'''How''' is it", {"wiki"}), ("an {{lang|en|odd}} one", {"wiki"}), ("so.\n== Aim ==\nAfter that.", {"wiki"}),
    ('so.\n{| class="wide"\n! n !! m\n|-\n| 2 || 80\n|}', {"wiki"}),
    ("<p>With $\\alpha^2$ and **bold** text.</p>", {"html", "latex", "markdown"}),
    ("each run costs about $2 per sample, later only $27.", set()), ("here a<b and c>d whenever it is", set()), ("the growth is 13**2 per step", set()),
    ("p < 0.05 and n > 41 only", set()), ("lie in C:\\data\\plasma on the old node", set()), ("the matrix [[1, 2], [3, 44]] is exact", set()),
    ("the variable max_term_freq is set", set()), ("Q&A logs and R&D notes", set()), ("we ran the Q&A; it took 3 hours", set()), ("cells (* = noisy) and * marks", set()),
    ("5 * 3 = 15", set()), ("see [12] and [3, 4]", set()), ("Item #1 of the list", set()), ("../a/b.txt and $HOME are kept", set()), ("plain words", set()),
]


def test_markup_cases():
    on = markup.judged([t for t, _ in MARKUP], markup.model())
    for (text, expected), nodes in zip(MARKUP, on):
        assert {dom.LANGUAGE[n.kind[0]] for n in nodes} == expected, text


def test_markup_held_out_accuracy():
    x, y = markup.training_rows(400, seed=1234)
    assert ((markup.model().logits(x) > 0) == (y > 0)).mean() > 0.96


def held_out_figures(fold: int, texts: int = 1200) -> tuple[float, float]:
    """Recall and precision, by node, on families of constructs and look-alikes that the fit
    never saw."""
    from paperloom.llm.boosting import fit

    trees = fit(*markup.training_rows(texts, fold=fold))
    x, y = markup.training_rows(texts // 3, seed=99, fold=fold, held_out=True)
    said, real = trees.logits(x) > 0, y > 0
    return (said & real).sum() / real.sum(), (said & real).sum() / said.sum()


def test_markup_of_unseen_families():
    recall, precision = held_out_figures(1)
    assert recall > 0.8 and precision > 0.8


def test_decoding_has_no_contradiction():
    text = "```\n<b>x</b> and [[y]]\n```\n<!-- **z** --> $a_{b}$"
    nodes = dom.parse(text)
    for n in nodes:
        n.logit = 5.0 if n.kind in dom.OPAQUE else 1.0
    assert {n.kind for n in dom.decode(nodes)} <= {"m_fence", "h_comment", "t_dollar", "t_command"}


def test_clean_text():
    cases = {
        "<h2>Aim</h2><p>A <b>b</b> &amp; c</p><ul><li>x</li><li>y</li></ul>": "## Aim\n\nA b & c\n\n- x\n- y",
        "\\section{Aim} A \\emph{b} with $\\frac{a}{b}$": "# Aim\n A b with $\\frac{a}{b}$",
        "{\\it The} set {a, b}": "The set {a, b}",
        "== Aim ==\n* [[one]]\n* [[two|2]]\nEnd '''now'''.": "# Aim\n- one\n- 2\nEnd now.",
        "Aim\n===\n\nA **b** [c](/d).": "# Aim\n\nA b c.",
        "as\n\\begin{equation}\nx = 1\n\\end{equation}": "as\n\n$$x = 1$$",
        "caf\\'{e} and 5\\%": "café and 5%",
    }
    for (text, clean), nodes in zip(cases.items(), markup.judged(list(cases), markup.model())):
        assert markup.render(text, nodes) == clean


def test_markup_frame(spark):
    deep = "<b>" * 3000 + "x" + "</b>" * 3000
    df = spark.createDataFrame([(1, "a <i>b</i>", None, "m"), (2, None, "", "m"), (3, deep, "x" * 100_000, "m"), (1, "a <i>b</i>", None, "m")],
                               "line_no long, title string, abstract string, markup string")
    assert rows(markup.find_markup(df, "line_no", ["title", "abstract"])) == [(1, "title", "html"), (1, "title", "html"), (3, "title", "html")]
    clean = markup.clean_markup(df, "line_no", ["title", "abstract"])
    assert clean.count() == 8 and clean.filter("line_no = 2 and field = 'title'").first()["clean"] is None
    assert markup.find_markup(df.limit(0), "line_no", ["title"]).count() == 0


GROUPS = [
    ["Theodore M. Zitraplekrin", "T. Zitraplekrin", "Zitraplekrin, T. M.", "Theodore Zitaplekrin", "THEODORE ZITRAPLEKRIN", "Ted Zitraplekrin", "Dr. Theodore Zitraplekrin"],
    ["Christopher de la Leletrorysk", "DE LA LELETRORYSK, Christopher", "Christopher de la Lele-Trorysk"],
    ["Francisco Zavypostold", "Zavypostold Francisco", "Frncisco Zavypostold", "Paco Zavypostold"],
    ["Valentina Brustividold", "Valentina Brustivídold", "V Brustividold"],
    ["Merutripur Collaboration", "The Merutripur Collaboration", "MERUTRIPUR COLLABORATION", "Merutripur Coll.", "Merutirpur collaboration"],
    ["Anton Givisy"], ["Anton Givisy, Jr."], ["Anton Givisy III"], ["Carmen Givisy"], ["Carlos Givisy"], ["W. Dufymur"], ["V. Dufymur"], ["Emil Bylutry"], ["Emil Kepinass"],
]


def test_names_are_linked(spark):
    table = spark.createDataFrame([(n,) for g in GROUPS for n in g] * 2, "name string").distinct()
    got = rows(names.spelling_pairs(names.link_names(table)))
    expected = sorted((a, b) for g in GROUPS for a in g for b in g if a < b)
    assert got == expected


def test_name_tables(spark):
    a = spark.createDataFrame([("Unknown", 1), ("A Bcd; A. Bcd", 2), (None, 3), ("", 4)], "authors string, name long")
    assert rows(names.author_values(a, a)) == [("A Bcd",), ("A. Bcd",)]
    assert names.link_names(names.author_values(a.limit(0))).count() == 0


def test_alike_families_against_brute_force(spark):
    r = random.Random(2)
    words = {"".join(r.choice(["ka", "ro", "mi", "su", "tel"]) for _ in range(5)) for _ in range(120)}
    words |= {w[:3] + w[4:] for w in list(words)[:40]} | {w[:2] + w[3] + w[2] + w[4:] for w in list(words)[:40]}
    words = {w for w in words if len(w) >= names.TWICE}
    import math
    from collections import Counter

    grams = {w: Counter(f"^{w}$"[i:i + 3] for i in range(len(w))) for w in words}
    df = Counter(g for c in grams.values() for g in c)
    vec = {w: {g: n * math.log1p(1 / (df[g] / len(words) + names.FLOOR)) for g, n in c.items()} for w, c in grams.items()}
    norm = {w: math.sqrt(sum(x * x for x in v.values())) for w, v in vec.items()}
    cos = lambda a, b: sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) / norm[a] / norm[b]
    near = {(a, b) for a in words for b in words if a < b and names.edits(a, b, 1) <= 1 and cos(a, b) >= names.FAMILY_COSINE}
    table = spark.createDataFrame([("p", w) for w in words], "kind string, family string")
    found = {(x["fa"], x["fb"]): x["cosine"] for x in names.alike_families(table).collect()}
    assert near <= set(found)
    assert all(abs(c - cos(*p)) < 1e-9 for p, c in found.items())


def test_one_edit_families_against_brute_force(spark):
    r = random.Random(4)
    words = {"".join(r.choice("abé") for _ in range(r.randint(2, 7))) for _ in range(150)} | {"a🙂bc", "a🙂cb", "abc🙂"}
    table = spark.createDataFrame([(k, w) for k in ("p", "g") for w in words] * 2, "kind string, family string")
    expected = sorted((k, a, b) for k in ("p", "g") for a in words for b in words
                      if a < b and names.edits(a, b) == 1 and min(len(a), len(b)) >= names.EDITABLE)
    assert rows(names.one_edit_families(table)) == expected
    assert names.one_edit_families(table.limit(0)).count() == 0


def test_names_are_linked_whatever_the_cosine_of_their_families(spark):
    """Common trigrams weigh little beside those a typo makes."""
    r = random.Random(6)
    others = ["Anton Kal" + "".join(r.choice("bdfgpt") for _ in range(6)) + "mar" for _ in range(300)]
    table = spark.createDataFrame([(n,) for n in ["Theodore Kalomar", "Theodore Kalumar", *others]], "name string").distinct()
    families = names.readings(table).select("kind", "family").distinct()
    assert names.alike_families(families).filter("fa = 'kalomar' and fb = 'kalumar'").count() == 0
    assert ("Theodore Kalomar", "Theodore Kalumar") in rows(names.spelling_pairs(names.link_names(table)))


def test_far_spellings_and_abbreviations(spark):
    linked = [("Jan Kowalczyk", "Jan Kovalchyk"), ("Brzeczyszczykiewicz, Anna", "Anna Brzenczyszczykiewcz"), ("William Smith", "Wm. Smith")]
    apart = ["Katherine Lyfapikun", "Katherine Syfapizun", "Nokonuvyn Collaboration", "Vokonudyn Collaboration", "Wm. Jones", "Walter Smith"]
    table = spark.createDataFrame([(n,) for p in linked for n in p] + [(n,) for n in apart], "name string")
    assert rows(names.spelling_pairs(names.link_names(table))) == sorted(tuple(sorted(p)) for p in linked)


def test_cosines_decide(spark):
    """Cosines are those of brute force, pairs below the threshold are no links, and a higher
    threshold gives fewer."""
    import math
    from collections import Counter

    table = spark.createDataFrame([(n,) for g in GROUPS for n in g], "name string").distinct()
    read = names.readings(table)
    links = names.one_edit_families(read.select("kind", "family").distinct())
    whole = {x["name"]: [(x["family"], 1.0)] + [(g, names.GIVEN) for g in x["given"].split(" ") if g] for x in read.filter("first").collect()}
    tf = {}
    for n, parts in whole.items():
        tf[n] = Counter()
        for w, weight in parts:
            p = f"^{w}$"
            for i in range(max(len(p) - 2, 1)):
                tf[n][p[i:i + 3]] += weight
    df = Counter(g for c in tf.values() for g in c)
    vec = {n: {g: k * math.log1p(1 / (df[g] / len(tf) + names.FLOOR)) for g, k in c.items()} for n, c in tf.items()}
    norm = {n: math.sqrt(sum(x * x for x in v.values())) for n, v in vec.items()}
    cos = lambda a, b: sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) / norm[a] / norm[b]
    got = {(x["a"], x["b"]): x["s"] for x in names.name_pairs(read, links, 0.0).collect()}
    assert len(got) > 30 and all(s == 0 or abs(s - cos(*p)) < 1e-8 for p, s in got.items())
    counts = [names.name_pairs(read, links, t).filter("s > 0").count() for t in (0.0, 0.5, 0.7, 0.9)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[3]
    many, few = (names.spelling_pairs(names.link_names(table, t)).count() for t in (names.COSINE, 0.8))
    assert many > few > 0
    # recall of brute force: every pair no rule forbids and of cosine enough is among the pairs
    four = {x["name"]: [] for x in read.collect()}
    for x in read.collect():
        four[x["name"]].append(((x["kind"], x["family"], x["given"], x["suffix"]), x["first"]))
    due = {(a, b) for a in four for b in four if a < b and cos(a, b) >= names.COSINE
           and any(names.may_be_one(p, q) == 2 and (f or g) for p, f in four[a] for q, g in four[b])}
    assert len(due & set(got)) >= 0.99 * len(due)


def test_a_common_family_name_is_no_single_task(spark, monkeypatch):
    """Given names that contradict each other don't meet, and a key with many rows is spread."""
    r = random.Random(8)
    given = {"".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(4)).capitalize() for _ in range(400)}
    many = [f"{g} Smith" for g in given] + [f"{g[0]}. Smith" for g in given]
    table = spark.createDataFrame([(n,) for n in many], "name string").distinct()
    read = names.readings(table)
    links = names.one_edit_families(read.select("kind", "family").distinct())
    pairs = rows(names.candidates(read, links))
    assert len(pairs) < 3 * len(many)  # 80,000 are of one family
    monkeypatch.setattr(names, "HOT_ROWS", 5)
    assert rows(names.candidates(read, links)) == pairs
    monkeypatch.setattr(names, "MANY", 10**6)
    assert rows(names.candidates(read, links)) == pairs


RESIDUE = [
    "Please enable JavaScript to view this paper.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAPER.", "404 Not Found", "A fine text. Insert acknowledgements here. More text.",
    "Results hold. Cite as: ${citation}. Then more.", "Received %DATE%, accepted %DATE%.", "{{title}}\n\n{{authors}}", "TBD", "Lorem ipsum dolor quasi tenor vitae novum.",
    "bla bla bla bla bla bla bla bla", "抱歉，您访问的页面不存在。", "Für das Feld. Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "xxx xxxx xx xxxxx. xxx xxxx xx xxxxx.",
    "It runs. [TODO: add the measure numbers] We go on.", "they're Sorry, this section could not be loaded. Please try again later.", "Title: %TITLE%\nAuthors: %AUTHORS%",
    "Dear {reviewer}, thank you for your time.", "The data are available at <INSERT LINK>.", "x " * 5000 + "Enable JavaScript to see the comments.",
]
GENUINE = [
    None, "", "  \n", "We measure how often archive mirrors answer with 404 Not Found and how long a 503 lasts.", "A TODO comment in source code predicts later repair of the parser.",
    "Our template language writes a slot as double braces, so that {{name}} stands for a value at run time.", 'Participants saw the message "access denied" in 3 of the trials.',
    "The filler phrase lorem ipsum serves as a control stimulus in our reading study.", "In the crawl, 46% of the pages only asked the reader to enable JavaScript, and we removed them.",
    "Captcha solving is a smooth task for the channel.", "The placeholder particle of the kibat gradient is not observed.", "Variables such as $x and %name% are expanded by the finos shell before the filament runs.",
    "The set {a, b, c} has 10 elements & no cavity.", "Here a<b and c>d whenever the survey is planar.", "The matrix [[1, 2], [3, 3]] is compact.", "Error rates of 500 per hour were internal to the server wave.", "word " * 20000,
    "The set {theorem} is closed.", "Let ${x+y}$ be the sum and {alpha_beta} the pair.", "The directive <<include>> joins two files.",
]


def test_residue(spark):
    texts = RESIDUE + GENUINE + RESIDUE[:1]
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, residue string")
    got = {r["doc_id"]: r["residue"] for r in residue.flag_residue(df).collect()}
    wrong = [texts[i] for i in range(len(texts)) if got[i] != (i < len(RESIDUE) or i >= len(RESIDUE) + len(GENUINE))]
    assert not wrong
    assert residue.flag_residue(df.limit(0)).count() == 0


def test_prefix_index_loses_nothing():
    """Every exemplar finds itself, with any one light token missing."""
    m = residue.Matcher({}, 1000)
    for i, e in enumerate(m.items):
        if len(e.tokens) > 6:
            drop = min(range(len(e.tokens)), key=lambda j: m.idf[e.tokens[j]])
            words = [w for j, w in enumerate(e.tokens) if j != drop]
            assert not m._windows(i, words, 0, len(words)) or any(i in m.index.get(w, ()) for w in words)


#: Messages of other makers, not in the library and not in the test data.
UNSEEN = [
    "Please activate JavaScript in your browser settings to read this article.", "Scripts must be enabled to view the full text.", "Turn on JavaScript to continue.",
    "JavaScript is turned off. Please allow scripts and reload.", "Oops! Something went wrong on our end.", "ERR_CONNECTION_REFUSED", "504 Gateway Timeout",
    "HTTP Error 503", "We can't find the document you're looking for.", "The resource you requested could not be found.", "This article is no longer available.",
    "Please verify that you are human.", "Checking your browser before you proceed...", "Your session has expired.", "[PLACEHOLDER FOR ABSTRACT]", "Insert figure caption here.",
    "Type your summary here. Abstract goes here.", "Author name, affiliation of first author", "Bitte schalten Sie JavaScript ein, um fortzufahren.", "Ein Fehler ist aufgetreten.",
    "Une erreur est survenue, veuillez réessayer.", "Ha ocurrido: se ha producido un error.", "Произошла ошибка. Попробуйте позже.", "找不到页面。", "Uncaught exception in module loader",
    "Dear {first_name}, welcome.", "<%= article.title %>", "#{author} wrote it.", "Blah blah blah blah.", "Consectetur adipiscing elit, sed do eiusmod tempor.",
    "An unexpected error occurred.", "Service temporarily unavailable", "Please enable cookies.", "To be announced", "qwerty asdf zxcv",
]
#: Sentences that hold the same words or signs in another role.
SPOKEN = [
    "Pages that only said the page was not found were removed from the crawl.", "We asked participants to enable scripts in half of the trials.", "The set {theorem} is closed.",
    "Let {alpha_beta} be the pair and ${x+y}$ its sum.", "The directive <<include>> joins two files.", "A stack overflow is a common fault in recursive parsers.",
    "Our measure of error 404 rates per mirror is stable.", "The string lorem ipsum is a filler phrase of typesetters.", "Template variables such as {{ title }} are expanded late.",
    "The captcha task is hard for machines.", "In this section we test the test set.", "Labor and magna charta are topics in it.", "The service was unavailable to 40% of the rural population in the study.",
    "La culpa no es del dolor.", "Connection topologies refused by the referee are listed in Table 2.", "The traceback of the alignment starts at the most recent call of the last row.",
]


def test_unseen_residue_and_mentions():
    """Held out: neither list was used to write the library."""
    m = residue.Matcher({}, 1000)
    found, wrong = [t for t in UNSEEN if m.matches(t)], [t for t in SPOKEN if m.matches(t)]
    assert len(found) >= 0.85 * len(UNSEEN), set(UNSEEN) - set(found)
    assert len(wrong) <= 0.1 * len(SPOKEN), wrong


def test_exemplars_stand_in_for_each_other():
    """Held-out lines: a good part of the library is found without its own line."""
    items = residue.exemplars()
    own = [i for i, e in enumerate(items) if len(e.tokens) > 2]
    found = 0
    for i in own:
        m = residue.Matcher({}, 1000, library=items[:i] + items[i + 1:])
        words = [next(iter(residue.CLASSES[w].split())) if w in residue.CLASSES else w for w in items[i].tokens]
        found += m.matches(" ".join(words))
    assert found >= 0.25 * len(own)


def test_filler_in_containment_and_under_the_veto():
    m = residue.Matcher({}, 1000)
    for text in ("A fine text. Lorem ipsum dolor sit amet. More of it.", "The scan shows that lorem ipsum dolor sit amet holds for all.",
                 "We ran it. Bla bla bla bla bla. It held.", "So we saw. Sed do eiusmod tempor incididunt labore."):
        assert m.matches(text), text
    for text in ("The filler phrase lorem ipsum dolor sit amet consectetur serves as a control stimulus in our reading study.",
                 "The filler phrase lorem ipsum dolor sit amet serves as a control stimulus in our reading study.",
                 "We test testing in labor wards. A sample. In vitro, do it."):
        assert not m.matches(text), text


def test_stand_alone_after_running_text():
    m = residue.Matcher({}, 1000)
    for text in ("The server returned page not found. Page not found", "It was said that page not found. Then page not found again. Page not found.",
                 "We did all of this work very well over there. 500 Internal Server Error. It held."):
        assert m.matches(text), text
    for text in ("The server returned page not found twice.", "The page not found here and the page not found there are two."):
        assert not m.matches(text), text


def test_slots_of_any_length():
    m = residue.Matcher({}, 1000)
    for slot in ("{% if " + "a and " * 60 + "b %}", "${" + "name." * 40 + "x}", "{{ title | upper }}", "{{ title|upper | trim }}", "__TITLE_2__", "[TODO: " + "add it " * 30 + "]"):
        assert residue.tokenize(f"It is {slot} so.")[0][2] == "<slot>", slot
        assert m.matches(f"It runs well. {slot} We go on."), slot
    assert "<slot>" not in residue.tokenize("{% never closed " * 20000 + "<% " * 20000)[0]


def test_markup_of_any_size():
    formula = "$" + " + ".join(f"\\alpha_{{{i}}} x^{{{i}}}" for i in range(60)) + "$"
    scripts = "$" + " + ".join(f"x_{{{i}}}" for i in range(60)) + "$"
    prices = "each run costs about $2 per sample, " + "and the plain words go on and on here " * 15 + "later only $27."
    texts = [f"We have {formula} in all.", f"We have {scripts} in all.", prices]
    on = markup.judged(texts, markup.model())
    assert [{dom.LANGUAGE[n.kind[0]] for n in nodes} for nodes in on] == [{"latex"}, {"latex"}, set()]
    assert [markup.render(t, nodes) for t, nodes in zip(texts, on)] == texts  # formulas are kept
    far = "<section>" + "".join(f"<x{i}>" for i in range(100)) + "a</section><b>c</b></x3>"
    assert {(n.kind, n.name) for n in dom.parse(far) if n.kind == "h_element"} == {("h_element", "section"), ("h_element", "b")}
    # as many siblings as there may be: what lies inside others does not count among them
    row = lambda n: dom.features(t := "<i>a</i>" * n + "<p>" + "<u>b</u>" * 30 + "</p>", dom.parse(t))[0]
    few, many = row(399), row(400)
    at = [i for i, (a, b) in enumerate(zip(few, many)) if abs(a - b) > 0.01]
    assert not at, at
