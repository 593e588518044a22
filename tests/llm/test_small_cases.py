"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import ann, html, mixing, neardup, packing, pii, quality, sharding, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, found string, row_id string, kept string"
PROSE = " ".join(f"w{i % 97}x{i % 31}" for i in range(400))
LONG = " ".join(f"long{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, None, "a"), (4, "", None), (5, " \n\t ", "b"),
        (None, PROSE + " end", None), (None, None, None), (6, LONG, "b"), (7, "one two", "c"), (8, "x" * 100_000, "c"),
        (9, "one two", "c"), (10, "é ß   漢字   𝒳", "c"),
    ]
    rows = [(d, t, None, s, None if t is None else len(t), 5, "x", "y", "z") for d, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(odd, none):
    got = sharding.assign_shards(odd, shards=4).collect()
    assert len(got) == 13
    for r in got:
        assert 0 <= r["shard"] < 4
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["text_crc32"] for r in got if r["doc_id"] == 1} == {zlib.crc32(PROSE.encode())}
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 3} == {(16, 0)}
    assert sharding.assign_shards(none).collect() == []


def test_shard_files(odd, tmp_path, spark):
    sharding.write_shards(odd, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 13 and {"shard", "slot", "text", "kept"} <= set(back.columns)


def test_html(spark):
    rows = [
        (1, "http://h/a", "<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "x"),
        (2, None, None, "x"), (3, "http://h/b", "", "x"), (None, "nonsense", "<div class='ad'>buy</div>", "x"),
        (4, "http://h/c", "<p>Follow us on all of our many channels today</p><p>first story of its own kind here</p>", "x"),
        (5, "http://h/d", "<p>Follow us on all of our many channels today</p><p>second tale nobody else has told</p>", "x"),
        (6, "http://h/e", "<article>cut <b>off", "x"), (6, "http://h/e", "<article>cut <b>off", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string")
    got = [(r["page_id"], r["text"]) for r in html.extract(pages).collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, "A & B\none two three\nfour"), (2, ""), (3, ""), (None, ""),
            (4, "first story of its own kind here"), (5, "second tale nobody else has told"),
            (6, "cut off"), (6, "cut off"),
        ],
        key=repr,
    )
    assert html.extract(pages.limit(0)).collect() == []


def test_html_without_article_element(spark):
    follow = "<p>Follow us on all of our many channels today</p>"
    story = " ".join(f"told{i}" for i in range(60))
    quote = "as the old saying goes in this town of ours"
    rows = [(1, "http://h/a", f"{follow}<div>{story}</div>"), (2, "http://h/b", f"{follow}<div>{story}</div>")]
    rows += [(3, "http://h/c", f"{follow}<p>Ann said {quote} to Bob</p>"), (4, "http://h/d", f"{follow}<p>Eve wrote {quote} on walls</p>")]
    rows += [(5, "http://g/a", f"<p>Monday</p><p>{story}</p>"), (6, "http://g/b", f"<p>Tuesday</p><p>{story}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == {
        1: story, 2: story, 3: f"Ann said {quote} to Bob", 4: f"Eve wrote {quote} on walls",
        5: f"Monday\n{story}", 6: f"Tuesday\n{story}",
    }


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<div class='layout has-sidebar no-ads with-comments'><article>a story</article></div>", ["a story"]),
        ("<div class='social'><article>a story</article></div><p class='ad-slot'>buy</p>", ["a story"]),
        ("<form action='/'><nav>menu</nav><main>a story</main></form>", ["a story"]),
        ("<form action='/'><nav>menu</nav><div>a story</div></form>", ["a story"]),
        ("<article><header class='header'><h1 class='header'>Title</h1></header>text</article>", ["Title", "text"]),
        ("<article><section class='social-science'>text</section><div class='share-buttons'>x</div></article>", ["text"]),
        ("<article><p title='a hidden truth'>text</p><p hidden>x</p><p style='display: none'>y</p></article>", ["text"]),
        ("<article>text</article><div class='comments'><article>me too</article></div>", ["text"]),
        ("<p>text</p><div class='comments'><article>me too</article></div><form>search</form>", ["text"]),
    ],
)
def test_html_marks(page, expected):
    assert [t for _, t in html.blocks(page)] == expected


@pytest.mark.parametrize("page", ["<" * 50_000, "<p a='" * 20_000, "</i>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<!" * 50_000])
def test_html_is_linear(page):
    html.blocks(page)


def test_mixing(odd, none):
    got = mixing.mix(odd, shards=3, block_words=100).collect()
    assert len(got) == 13
    for r in got:
        assert len(r["draws"]) <= 3 and all(0 <= d["shard"] < 3 for d in r["draws"])
    again = mixing.mix(odd, shards=3, block_words=100).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixing_with_one_long_document(spark):
    rows = [(i, f"{500 + 37 * i % 101}", "a") for i in range(540)] + [(9999, "200000", "a")]
    rows += [(10_000 + i, f"{300 + 53 * i % 211}", "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, n string, source string")
    docs = docs.withColumn("text", F.expr("trim(repeat('w ', int(n)))")).drop("n").cache()
    for seed in range(12):
        got = mixing.mix(docs, share=0.9 + seed / 7, seed=seed).collect()
        for source in "ab":
            own = [r for r in got if r["source"] == source]
            assert abs(sum(r["size"] * len(r["draws"]) for r in own) - own[0]["target"]) <= 200
            assert max(len(r["draws"]) for r in own) - min(len(r["draws"]) for r in own) <= 1


def test_mixing_skips_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(i, 50 + 37 * i % 101, "a") for i in range(1500)] + [(5000 + i, 30_000, "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string")
    docs = docs.withColumn("text", F.expr("trim(repeat('w ', n))")).drop("n").cache()
    for seed in range(4):
        got = mixing.mix(docs, share=0.3 + seed / 7, block_words=5_000, seed=seed).collect()
        assert abs(sum(r["size"] * len(r["draws"]) for r in got) - got[0]["target"]) <= 50


def test_near_duplicates(odd, none):
    got = neardup.classes(odd).collect()
    assert len(got) == 13
    by = [(r["doc_id"], r["class_id"], r["class_size"]) for r in got]
    assert sorted(by, key=repr) == sorted(
        [
            (1, 1, 4), (2, 1, 4), (2, 1, 4), (None, 1, 4), (3, 3, 1), (4, 4, 1), (5, 5, 1), (None, None, 1), (6, 6, 1),
            (7, 7, 2), (9, 7, 2), (8, 8, 1), (10, 10, 1),
        ],
        key=repr,
    )
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert neardup.classes(none).collect() == []


def test_packing(odd, none):
    got = packing.pack(odd, capacity=1000, group_rows=4).collect()
    words = {}
    for r in got:
        words[r["row_id"]] = words.get(r["row_id"], 0) + r["n_words"]
    assert len(words) == 13 and sum(words.values()) == sum(len((t or "").encode().split()) for (t,) in odd.select("text").collect())
    bins = {}
    for r in got:
        if r["n_words"]:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None and r["position"] is None
    for held in bins.values():
        assert sum(r["n_words"] for r in held) == held[0]["bin_words"] <= 1000
        assert len({r["source"] for r in held}) == len(held)
        assert sorted(r["position"] for r in held) == list(range(len(held)))
    assert packing.pack(none).collect() == []


def test_quality(odd, none):
    got = quality.judge(odd)
    assert set(odd.columns) <= set(got.columns) and got.count() == 13
    assert {r["rejected_by"] for r in got.where("doc_id in (1, 3, 4, 5)").collect()} == {None}
    assert quality.judge(none).collect() == []


def test_repeat_words(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", None, "a b c x a b c", "a b c b c a b c", "p q r s t"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = quality.words(F.col("text"))
    got = [r[0] for r in rows.withColumn("found", found).select(quality.n_repeat_words(F.col("found"))).collect()]

    def slow(text):
        w = (text or "").split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})

    assert got == [slow(t) for t in texts]


def test_pii(odd, none):
    got = {r["doc_id"]: r for r in pii.digest(odd).collect()}
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["spans"] == ""
    assert pii.detect(odd).count() == 13 and pii.redacted(odd).columns == odd.columns
    assert pii.redacted(odd).where("text is null").count() == 2
    assert pii.digest(none).collect() == []


def test_pii_long_secret():
    key = "".join("aB3dE6gH9k"[i * i % 10] + "QwX7z"[i % 5] for i in range(300))
    assert pii.find_spans(f"the api key {key} ends") == [("secret", 12, 612, 0.8)]
    assert pii.find_spans(f"an image {key} ends") == []


def test_neighbours(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.5, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (1, [1.0, 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vectors.withColumn("id", F.lit("x")).withColumn("rank", F.lit(3))
    got = ann.nearest(vectors, F.col("vec_id").isin(1, 4, 10), k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0.5), (1, 2, 3, 0.5)]
    assert ann.nearest(vectors.limit(0), F.lit(True)).collect() == []


def test_neighbours_of_repeated_rows(spark):
    draw = np.random.default_rng(3)
    m = draw.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows = rows * 2 + [(17, m[17].tolist())] * 50 + [(5, (m[5] + j).tolist()) for j in range(1, 40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 10 == 7, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(7, 400, 10))
    for q, found in got.items():
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(v, m[q])))
        assert found == sorted(best, key=lambda i: (-best[i], i))[:20]


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd, labels)
    got = toxicity.score_documents(odd, model)
    assert got.count() == 13 and got.where("toxicity between 0 and 1").count() == 13
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.score_documents(none, toxicity.learn(none, labels.limit(0))).collect() == []


def test_substrings(odd, none):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.keep_first(odd).collect()]
    assert (1, 400, 0) in got and got.count((2, 400, 400)) == 2 and (None, 401, 400) in got
    assert (3, 0, 0) in got and (6, 30_000, 0) in got and (9, 2, 0) in got
    assert substrings.keep_first(none).collect() == []


def test_hilbert_curve_moves_one_cell_at_a_time():
    side = 1 << 3
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = ann.hilbert(cells, bits=3)
    assert sorted(key) == list(range(side**3))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<html><head><title>T</title><body><article><p>Hello world</p></article></body></html>", ["Hello world"]),
        ("<html><head><meta charset=x><title>T</title><article><p>Hello</p></article>", ["Hello"]),
        ("<head><title>T</title>Hello<p>there", ["Hello", "there"]),
        ("<head><link rel=x><script>a</script><style>b</style></head><p>Hello", ["Hello"]),
        ("<article><script>x</script bad><p>Hi</p></article>", ["Hi"]),
        ("<article><script>x</scripty></script\n><p>Hi</p></article>", ["Hi"]),
        ("<article><p title=it's>Hello</p><p>Next</p></article>", ["Hello", "Next"]),
        ("<article><p title = 'a > b' class=\"x>y\">Hello</p><p 'odd\">Next</p></article>", ["Hello", "Next"]),
        ("<div class='content sidebar-right'><p>Story text</p></div>", ["Story text"]),
        ("<div class='sidebar-right'><p>Menu</p></div><div class='comments content'>me too</div><p>text</p>", ["text"]),
        ("<article><p>So <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>a=1</annotation></math> holds</p></article>", ["So a=1 holds"]),
    ],
)
def test_html_keeps_text(page, expected):
    assert [t for _, t in html.blocks(page)] == expected


def test_html_keeps_a_story_under_three_addresses(spark):
    story = " ".join(f"told{i}" for i in range(60))
    line = lambda n, i: " ".join(f"line{n}x{i}y{j}" for j in range(9))
    rows = [(i, f"http://h/{i}", f"<p>{line('head', i)}</p><div>{story}</div><p>{line('tail', i)}</p>") for i in range(3)]
    menu = "Follow us on all of our many channels today"
    rows += [(10 + i, f"http://g/{i}", f"<p>{menu}</p><div>{line('a', i)} {line('b', i)}</div>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert all(story in got[i] for i in range(3))
    assert [got[10 + i] for i in range(4)] == [f"{line('a', i)} {line('b', i)}" for i in range(4)]


def test_toxicity_of_long_words_and_many_exceptions():
    import time

    model = toxicity.Model({" idiot ": 3.0}, frozenset({" no idiot here "}))
    start = time.perf_counter()
    assert len(toxicity.fold("x" * 1_000_000 + " 0")) > 1_000_000
    toxicity.fold("x" * 500_000 + "0" + "y@" * 250_000)
    matcher = model.automaton()
    assert toxicity.evidence(toxicity.fold("no idiot here " * 50_000), matcher) == 0.0
    assert time.perf_counter() - start < 2
    assert toxicity.fold("1d10t !! a!b @home c@t 007 x_1y") == " idiot aib home cat 007 x iy "


def test_matcher_against_a_plain_loop():
    draw = np.random.default_rng(4)
    words = ["ab", "abc", "bca", "cab", "a", "bc", "caba"]
    model = toxicity.Model({" ab ": 1.0, " abc ": 2.5, " ca": 0.5, " cab": 0.75}, frozenset({" a ab ", " abc bc ", " bc ca"}))
    matcher = model.automaton()
    for _ in range(300):
        text = toxicity.fold(" ".join(draw.choice(words, size=draw.integers(0, 30))))
        starts = {}
        for term, weight in model.weights.items():
            for i in range(len(text)):
                if text.startswith(term, i):
                    starts[i] = max(weight, starts.get(i, 0.0))
        spans = [(i, i + len(x) - 1) for x in model.exceptions for i in range(len(text)) if text.startswith(x, i)]
        total = sum(w for i, w in starts.items() if not any(a <= i < b for a, b in spans))
        assert toxicity.evidence(text, matcher) == pytest.approx(total / (1 + np.log1p(text.count(" ") / 200)))
