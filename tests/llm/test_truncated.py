"""Cut texts: spikes, endings, held-out accuracy, odd input."""

import random

import pytest

from quadrille.llm import truncated as T

NOUNS, VERBS = ["harbour", "garden", "tower", "library", "bridge", "mill"], ["opens", "closes", "counts", "repairs"]
MENUS = ["Home | News | Contact", "Prices", "garden Rikel", "Page 3 of 90", "Back to top", "© 2001 Kano Society", "12.5 14 88.2 7", "x = f(y)", "Loading more results…"]


def sentence(rng):
    s = f"The {rng.choice(NOUNS)} of {rng.choice(['Kano', 'Tegi'])} {rng.choice(VERBS)} the {rng.choice(NOUNS)} behind the old {rng.choice(NOUNS)}"
    return s + rng.choice([".", "!", "?", ", year after year..."])


def page(rng):
    lines = [rng.choice(MENUS) for _ in range(rng.randint(1, 4))] + [" ".join(sentence(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
    return "\n".join(lines), rng.choice([[], [rng.choice(MENUS)]])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, cut = [], set()
    for i in range(6000):
        body, foot = page(rng)
        source = rng.choice("abc")
        if source == "a" and len(body) > 300:
            text = body[:300]
            done = text.rstrip()[-1] in ".!?" or not text.split("\n")[-1].startswith("The ") or len(text.split("\n")[-1]) < 12
            cut |= set() if done else {i}
            rows.append((i, source, text, done and text.split("\n")[-1][-1:] not in ".!?"))
        elif rng.random() < 0.05:
            text = body[: -rng.randint(8, 20)]
            cut.add(i)
            rows.append((i, source, text + rng.choice(["", "...", "…", " \n", " [...]"]), False))
        else:
            rows.append((i, source, "\n".join([body, *foot]) + rng.choice(["", "\n", " "]), False))
    return rows, cut


def test_cuts_are_found(spark, corpus):
    rows, cut = corpus
    unsure = {i for i, *_, u in rows if u}
    d = spark.createDataFrame([(i, s, t, 1) for i, s, t, _ in rows], "doc_id long, source string, text string, cut int").repartition(4)
    got = {r.doc_id for r in T.judged(d).where("cut").collect()} - unsure
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.02 * len(cut)
    spikes = {(r.source, r.measure, r.length) for r in T.spikes(d).collect()}
    assert {("a", "chars", 300), ("a", "bytes", 300)} <= spikes and not {x for x in spikes if x[0] != "a"}
    ways = {r.doc_id: (r.by, r.at_spike) for r in T.judged(d).where("cut").collect()}
    assert {w for w in ways.values()} == {("spike", True), ("ending", False)}
    by = {r.source: r for r in T.by_source(T.judged(d)).collect()}
    assert sum(r.n_docs for r in by.values()) == 6000 and by["a"].share > 2 * by["b"].share


@pytest.mark.parametrize("limit", [40, 100, 255, 600])
def test_limits_of_any_length(spark, limit):
    """Half of the texts of a source are cut at a limit, short limits too; copies of one page are no limit."""
    rng = random.Random(limit)
    rows = []
    for i in range(400):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 12)))
        rows.append((i, "a", text[:limit] if i % 2 else text))
    rows += [(1000 + i, "b", "An error page that is the same for all") for i in range(200)] + [(2000 + i, "b", " ".join(sentence(rng) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {(r.source, r.measure, r.length) for r in T.spikes(d).collect()}
    assert got >= {("a", "chars", limit), ("a", "bytes", limit)}
    assert len("An error page that is the same for all") not in {x for s, _, x in got if s == "b"}
    want = {i for i, s, t in rows if s == "a" and len(t) == limit and not T._ENDS.search(t.rstrip())}
    assert want <= {r.doc_id for r in T.judged(d).where("by = 'spike'").collect()}


def test_built_in_endings_agree_with_python(spark, sf):
    """Where built-in expressions are sure, the exact reading of the line is the same."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    m = T.Model([])
    for r in T.at_spikes(d).where("sure AND last <> ''").collect():
        assert r.ended == (m.stops(r["last"]) is None), r["last"][-60:]


def test_held_out_accuracy_on_the_corpus(spark, sf):
    """Half of the pages fit the model; on the other half it tells cut lines from complete ones."""
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text)
    m = T.Model([t for i, t in texts if i % 2])
    rng, right, n, wrong, whole = random.Random(1), 0, 0, 0, 0
    for _, t in (x for x in texts if x[0] % 2 == 0):
        for line in [x for x in (T.plain(y).strip(T.BLANKS) for y in t.split("\n")) if x][:-1]:
            if not T._ENDS.search(line):
                whole += 1
                wrong += m.is_cut(line)
            elif len(line) > 40:
                part = line[: rng.randint(25, len(line) - 1)].rstrip(T.BLANKS)
                if not T._ENDS.search(part):
                    n += 1
                    right += m.is_cut(part)
    assert right >= 0.97 * n and wrong <= 0.01 * whole


def test_odd_texts(spark):
    rows = [(1, None, None), (2, "a", ""), (3, "a", " \n\t"), (4, None, "🌱☃"), (5, "a", "…"), (6, "a", "x" * 200_000), (6, "a", "Whole sentence."), (None, "a", "12 13.5 14")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, bytes int, last string")
    got = T.judged(d).collect()
    assert len(got) == len(rows) and not any(r.cut for r in got if r.doc_id in (1, 2, 3, 4, 5))
    assert {r.by for r in got} == {None} or {r.by for r in got if r.doc_id in (6, None)} <= {None, "ending"}
    assert T.judged(d.limit(0)).collect() == [] and T.by_source(T.judged(d.limit(0))).collect() == []


def test_repair():
    for x in ("Größe", "Наверх", "返回顶部", "« été »"):
        assert T.repaired(x.encode().decode("latin-1")) == x
        if x != "Наверх" and x != "返回顶部":
            assert T.repaired(x.encode().decode("cp1252")) == x
    assert T.repaired("café été") == "café été"


def test_endings_are_learnt_from_all_rows(spark):
    """Words that stand before an ellipsis in two of the few pages among many empty ones are known, whichever pages have them."""
    syllables = ["ka", "no", "ri", "tu", "me"]
    names = [a + b + c for a in syllables for b in syllables for c in ("l", "s")][:40]
    rows = [(i, "a", f"It was {n} after {n}... and so it went on.\nThe end of it.") for i, n in enumerate(names * 2)]
    rows += [(1000 + i, "a", f"Nothing else is known of it.\nIt was {n} after {n}...") for i, n in enumerate(names)]
    d = spark.createDataFrame(rows + [(10_000 + i, "b", "") for i in range(40_000)], "doc_id long, source string, text string").repartition(8)
    assert T.judged(d).where("cut").collect() == []


def test_long_texts_teach_endings(spark):
    """All lines but those of the endings are in one text of more than 20,000 characters."""
    rng = random.Random(5)
    lines = [x for _ in range(300) for x in (" ".join(sentence(rng) for _ in range(2)), rng.choice(["Prices and news", "Contact us", "Sign in", "About Kano"]))]
    text = "\n".join([*lines, "The end of it."])
    assert len(text) > 20_000
    rows = [(1, "a", text), (2, "a", "The tower of Kano opens the harbour behind the"), (3, "a", "Contact us"), (4, "a", "About Kano")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in T.judged(d).where("by = 'ending'").collect()} == {2}


def test_judgements_are_those_of_a_model_of_all_texts(spark, corpus):
    rows, _ = corpus
    m = T.Model([t for *_, t, _ in rows])
    last = {i: t.rstrip(T.BLANKS).split("\n")[-1] for i, _, t, _ in rows}
    d = spark.createDataFrame([(i, s, t) for i, s, t, _ in rows], "doc_id long, source string, text string")
    for parts in (1, 7):
        for r in T.judged(d.orderBy(d.doc_id * parts % 11).repartition(parts)).collect():
            want = m.stops(last[r.doc_id]) is not None if r.at_spike else m.is_cut(last[r.doc_id])
            assert r.cut == want, last[r.doc_id][-60:]


def test_marks_belong_to_words_by_their_share_of_texts():
    """Twice in a large corpus is no habit; in a small one it is."""
    pages = ["It rained year after year... and then stopped.\nThe end."] * 2
    assert T.Model(pages).natural == {"after year"}
    assert T.Model(pages + ["One.\nTwo."] * 4000).natural == set()
