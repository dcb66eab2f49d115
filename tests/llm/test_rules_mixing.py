import random
from collections import Counter

from textloom.llm import mixing, quality_rules

from ..oracle import same
from .conftest import LONG, PROSE


def plain_measures(text):
    words = text.encode().split()
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_a_plain_count():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["a ", "b ", "é\t", "x\n", "a b a b ", "#", "|* ", "\x0b", "漢字 ", " "]) for _ in range(draw.randint(0, 120)))
        assert quality_rules.measures(text.encode()) == plain_measures(text)


def test_verdicts_of_messy_rows(spark, messy, empty):
    got = quality_rules.verdicts(messy).collect()
    assert len(got) == messy.count()
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert by[(1, 0)]["base_failed"] and not by[(1, 0)]["kept"]
    assert by[(6, len(PROSE.split()))]["kept"] and by[(5, len(LONG.split()))]["kept"]
    assert quality_rules.verdicts(empty).count() == 0


def _prose(draw):
    return lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def _verdicts(spark, texts, host="h"):
    docs = spark.createDataFrame([(i, t, host) for i, t in texts.items()], "doc_id long, text string, source string")
    return docs, {r["doc_id"]: r for r in quality_rules.verdicts(docs).collect()}


def test_pasted_lines_go_and_copies_stay(spark):
    prose = _prose(random.Random(5))
    notice = "Accept all cookies to go on reading this page " + prose(30)
    texts = {i: f"{prose(30)}\n{notice}\n{prose(30)}" for i in range(40)}  # the notice in many settings
    texts |= {100 + i: f"{prose(4)}\n{notice} \n{prose(4)}" for i in range(3)}  # hardly more than the notice
    page = f"{prose(30)}\n{prose(30)}\n{prose(30)}"
    texts |= {200 + i: page for i in range(40)} | {300 + i: page + f"\n{prose(6)}" for i in range(9)}  # copies, and as many variants as the limit allows
    docs, got = _verdicts(spark, texts)
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == len(notice.split()) for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(3))
    assert all(got[i]["kept"] and not got[i]["n_removed_words"] for i in got if i >= 200)
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.clean(docs).collect()}
    assert set(cleaned) == {i for i in got if got[i]["kept"]} and notice not in cleaned[0] and cleaned[200] == page


def test_one_variant_more_than_the_limit(spark):
    prose = _prose(random.Random(6))
    page = f"{prose(30)}\n{prose(30)}"
    for variants, kept in ((10, True), (11, False)):
        _, got = _verdicts(spark, {i: f"{page}\n{prose(6)}" for i in range(variants)} | {100 + i: page.replace("a", "b") for i in range(30)})
        assert all(r["kept"] == (kept or i >= 100) for i, r in got.items())


def test_pages_that_are_hardly_more_than_boilerplate_go(spark):
    """However little a page has of its own, it is a document of its own: the more depleted, the surer it goes."""
    prose = _prose(random.Random(8))
    block = [prose(15) for _ in range(4)]
    for own in (1, 3, 6, 9, 25):
        texts = {i: "\n".join([*block[: i % 5], prose(own), *block[i % 5 :]]) for i in range(200)}
        _, got = _verdicts(spark, texts)
        assert all(r["n_removed_words"] == 60 and not r["kept"] for r in got.values()) and len(got) == 200
    _, got = _verdicts(spark, {i: "\n".join([*block, prose(26)]) for i in range(200)})  # 26 of 86 words are left
    assert all(r["kept"] for r in got.values())


def test_the_footer_of_a_template_goes(spark):
    """Lines of fixed wording with other values differ; what all pages share goes."""
    draw = random.Random(9)
    prose, footer = _prose(draw), _prose(draw)(12)
    texts = {i: f"The weather in {prose(2)} on the day of {prose(1)} was {prose(3)} all day long\nand the wind came from {prose(2)} with gusts of {prose(2)} near the coast\n{footer}" for i in range(300)}
    docs, got = _verdicts(spark, texts)
    assert all(r["kept"] and r["n_removed_words"] == 12 for r in got.values())
    assert not any(footer in r["text"] for r in quality_rules.clean(docs).collect())


def test_limits_are_of_the_host(spark):
    prose = _prose(random.Random(10))
    line, other = prose(10), prose(10)
    rows = [(i, f"{prose(30)}\n{line}\n{prose(5)} {i}", "large") for i in range(29)] + [(100 + i, f"{prose(30)}\n{other}", "large") for i in range(31)]
    rows += [(1000 + i, f"{prose(20)} {i}", "large") for i in range(15_000 - 60)]
    rows += [(20_000 + i, f"{prose(30)}\n{line}", None if i % 2 else "small") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r["doc_id"]: r["n_removed_words"] for r in quality_rules.verdicts(docs).collect()}
    assert {i for i, n in removed.items() if n} == {*range(100, 131), *range(20_000, 20_024)}  # 30 of 15,000 documents, 10 of a dozen


def test_clean_keeps_columns(messy, empty):
    out = quality_rules.clean(messy)
    assert out.columns == messy.columns and out.where("doc_id = 6").count() == 2
    assert quality_rules.clean(empty).count() == 0


def test_mixing_equals_its_sql(spark, sf):
    from textloom.llm import queries

    same(queries.op10_mixing(spark, sf), mixing.ORACLE, sf)


def test_the_query_sorts_the_mix(spark, sf):
    """All copies are range-sorted by position, and the result is taken from them."""
    from textloom.llm import queries

    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    queries.op10_mixing(spark, sf).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    assert any("rangepartitioning(position" in ran.apply(at).physicalPlanDescription() for at in range(first, ran.size()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = sorted((p, r["doc_id"], r["size"]) for r in mixing.curriculum(docs).collect() for p in r["positions"])
    starts, held = {}, 0
    for _, doc_id, size in copies:
        starts.setdefault(doc_id, held)
        held += size
    got = mixing.plan(docs).collect()
    assert starts and {r["doc_id"]: r["first_start"] for r in got if r["taken"]} == starts and sum(r["taken"] for r in got) == held


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([(f"={s}", n) for s, n in (("a", 10), ("b", 100), ("c", 1000))], "from string, source_size long")
    got = {r["from"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == {"=a": 20.0, "=b": 200.0, "=c": 1.5 * 1110 - 220}


def test_targets_of_many_sources_equal_a_plain_sharing(spark):
    draw = random.Random(2)
    sizes = {f"h{i}": draw.randint(1, 5000) for i in range(300)} | {"é": 7, None: 900}
    rows = [("-" if s is None else f"={s}", n) for s, n in sizes.items()]
    got = {r["from"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "from string, source_size long").repartition(7)).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        if not (over := {s for s in share if share[s] > 2 * sizes[s]}):
            break
        full |= over
    want = {s: 2 * sizes[s] if s in full else share[s] for s in names}
    assert all(abs(got["-" if s is None else f"={s}"] - t) < 1e-6 * max(t, 1) for s, t in want.items())


def test_mix_takes_near_targets_and_never_more_than_twice(spark, messy, empty):
    draw = random.Random(1)
    rows = [(i, "w " * draw.randint(1, 40), draw.choice("abc")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    for (_, target), g in got.groupby(["source_size", "target"]):
        assert abs(g["taken"].sum() - target) <= 40
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(r["text"].split()) for r in mixed.collect()) == got["taken"].sum()
    assert [r["doc_id"] for r in mixed.collect()] == [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert mixing.plan(messy).count() == messy.count() and mixing.mix(messy).columns == messy.columns
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
