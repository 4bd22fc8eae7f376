"""The training-data operators against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from harness import SF_DIR, difference
from pyspark.sql import functions as F

from lodeweave.llm import chat, dart_minhash, decontaminate, html_text, language, line_frequency, mixing, registry, sharding, substring_dedup, toxicity
from lodeweave.llm.shared import hash_sample

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (None, "no id here at all", "en", "a", 3), (2, "", "en", "a", 0), (3, " \n\t ", "de", None, 4), (4, long, None, "b", len(long)),
        (5, "same words in both rows", "en", "a", 1), (5, "same words in both rows", "en", "a", 1), (6, "same words in both rows", "fr", "b", 1), (7, "ünï çødé   text", "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for name in FOREIGN:
        df = df.withColumn(name, F.lit("mine"))
    return df


# Names that the operators use inside, as columns of somebody else's.
FOREIGN = """id band label g kept_text shard_key_ toxic_ mix_size_ _rank rank _text _p _at at _copy n node content size code source_size target_ class bucket buckets of cell first range before
_host host _words _lines _row row _gone h lines docs _scan _hits _windows _set w set item _content _found found found_ top head key crc spread value _doc x""".split()


def foreign_values(df) -> set:
    """What the foreign columns hold, of those the result should have."""
    assert set(FOREIGN) <= set(df.columns), set(FOREIGN) - set(df.columns)
    return {v for r in df.select(*FOREIGN).collect() for v in r}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF_DIR), registry.ORACLES[name]) is None


# ---- 1


def brute_repeats(texts: dict, window: int) -> dict:
    seen, where = Counter(), defaultdict(list)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] += 1
            where[d].append((i, k))
    out = {}
    for d, t in texts.items():
        w = words(t)
        gone = {j for i, k in where[d] if seen[k] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op1_substring_dedup(spark, SF_DIR).collect()}
    assert got == brute_repeats(texts, 35)


@pytest.mark.parametrize("window", [2, 3, 8])
def test_substring_dedup_of_small_windows(spark, window):
    base = [f"v{i * i % 23}" for i in range(60)]
    texts = {i: " ".join(base[i : i + 20 + i]) for i in range(12)} | {50: "a a a a a", 51: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.dedup_substrings(df, window=window, groups=3).collect()}
    assert got == brute_repeats(texts, window)


# ---- 2


def test_chat_round_trip():
    said = ["</s>[INST] ok [/INST]", "<s>[ROLE] user\n", "a\\b </\\s> <\\s>", "", "<|im_start|><\\|im_start|>"]
    turns = [(("user", "assistant")[i % 2], t) for i, t in enumerate(said)]
    formatted, spans = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[s["start"] : s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_folds_events(spark):
    rows = [
        (1, 0, "m0", "message", "user", "hi"), (1, 1, "m1", "delta", "assistant", "hel"), (1, 2, "m1", "delta", "assistant", "lo"), (1, 3, "m0", "edit", "user", "hi!"),
        (1, 4, "m1", "regenerate", "assistant", None), (1, 5, "m1", "delta", "assistant", "bye"), (2, 0, "m0", "message", "user", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, seq long, message string, kind string, role string, text string")
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_chats(df).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "bye")], 2: [("user", "")]}


def test_chat_of_odd_rows(spark):
    long = "word </s> " * 3000
    rows = [(None, None, None, None, "a"), (1, 0, "user", None, "a"), (1, 1, "assistant", long, "a"), (1, 1, "assistant", long, "b"), (2, None, None, "x", None), (3, 0, "assistant", "", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").withColumn("kind", F.lit("mine"))
    out = chat.format_chats(chat.as_events(df), order=("seq", "part"))
    got = {r["conv_id"]: (chat.read_back(r["formatted"]), len(r["loss"])) for r in out.collect()}
    assert got == {None: ([("", "")], 0), 1: ([("user", ""), ("assistant", long), ("assistant", long)], 2), 2: ([("", "x")], 0), 3: ([("assistant", "")], 1)}
    assert chat.format_chats(chat.as_events(df.limit(0)), order=("seq", "part")).count() == 0


def test_op2_very_long_turns(spark, tmp_path):
    """20 million characters in a turn take seconds; pieces never cut a character in two."""
    import time

    text = "é😀 said </s> and [INST]\n" * 870_000
    rows = [(1, 0, "user", "go"), (1, 1, "assistant", text), (1, 2, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    r = chat.op2_chat(spark, str(tmp_path)).filter("conv_id = 1").collect()[0]
    assert time.time() - began < 60
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (3, len(text), hashlib.sha256(text.encode()).hexdigest())


# ---- 3


def test_toxicity_finds_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    out = toxicity.op3_toxicity(spark, d)
    assert out.filter("p_toxic < 0 or p_toxic > 1").count() == 0
    pred = toxicity.op3_toxicity(spark, d).select("doc_id", F.col("toxic").alias("said"))
    both = pred.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "said").count().collect()
    n = {(r["toxic"], r["said"]): r["count"] for r in both}
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.02 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_toxicity_without_labels_and_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(odd, toxicity.with_labels(odd.select("doc_id", "text"), none), toxicity.label_categories())
    rows = out.collect()
    assert len(rows) == 9 and not any(r["toxic"] for r in rows) and {r["tox_toxic"] for r in rows} == {0.5}
    assert foreign_values(out) == {"mine"}
    some = spark.createDataFrame([(4, 0, 1), (4, 1, 0), (5, 1, 0), (6, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(odd, toxicity.with_labels(odd.select("doc_id", "text"), some), toxicity.label_categories())
    assert out.count() == 9 and foreign_values(out) == {"mine"}
    assert toxicity.toxicity(odd.limit(0), toxicity.with_labels(odd.select("doc_id", "text"), some), toxicity.label_categories()).count() == 0


def test_toxicity_of_held_out_documents(spark):
    """Trained on four fifths of the labelled documents by hash, judged on the others."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi").filter(held), toxicity.with_labels(docs, labels.filter(~held)), toxicity.label_categories())
    n = {(r["truth"], r["toxic"]): r["count"] for r in out.join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").groupBy("truth", "toxic").count().collect()}
    hit, missed, false = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    print(f"held out: recall {hit / (hit + missed):.3f}, precision {hit / (hit + false):.3f} of {sum(n.values())}")
    assert hit >= 0.8 * (hit + missed) and hit >= 0.95 * (hit + false)  # measured: 0.866 and 1.000


def test_samples_survive_ties(spark):
    same = spark.range(50).select(F.lit(7).alias("k"), "id")
    assert hash_sample(same, F.xxhash64("k"), 10).count() == 10
    assert 90 <= hash_sample(spark.range(1000), F.xxhash64("id"), 100).count() <= 100


# ---- 4


def test_language_of_held_out_texts(spark):
    out = language.op4_language(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in out.collect())


def test_rare_language_is_learned_beside_large_ones(spark):
    """3,000 texts of two large languages, 4 of a rare one: bounds are those of each language, so the rare one keeps all its words."""
    import random

    rng = random.Random(4)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)] for lang, letters, n in (("big", "abcdefgh", 900), ("large", "ijklmnop", 900), ("rare", "qrstuvwx", 60))}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["big", "large"] * 1500 + ["rare"] * 4)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(labelled, key=F.xxhash64("doc_id"), sample=200, most_words=300, most_grams=300)
    asked = [(lang, text(lang)) for lang in vocabulary for _ in range(50)]
    got = language.identify(spark.createDataFrame(asked, "lang string, text string"), model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_language_of_odd_rows(spark, odd):
    model = language.train(odd)
    got = language.identify(odd, model).collect()
    assert len(got) == 9
    assert {r["lang_pred"] for r in got if not re.search(r"[^\W\d_]", r["text"] or "")} == {"und"}
    assert foreign_values(language.identify(odd, model)) == {"mine"}
    empty = odd.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.train(empty)).collect()} == {"und"}


# ---- 5, 8, 9, 10


def test_line_quality_of_odd_rows(odd):
    rows = line_frequency.line_quality(odd).collect()
    assert len(rows) == 9 and sum(r["n_words"] for r in rows) == 30_000 + 5 + 3 * 5 + len(words("ünï çødé   text"))
    assert line_frequency.line_quality(odd.limit(0)).count() == 0
    for most in (line_frequency.MAX_SET, 0):
        assert foreign_values(line_frequency.line_quality(odd, min_docs=1, doc_share=0.0, max_set=most)) == {"mine"}


def test_frequent_lines_are_counted_by_host(spark):
    body = " ".join(f"x{i}" for i in range(60))
    rows = [(i, f"{body} {i}\nShared  LINE of the host", "en", "a" if i < 12 else "b", 1) for i in range(20)]
    got = {r["doc_id"]: r["line_words"] for r in line_frequency.line_quality(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: 5 if i < 12 else 0 for i in range(20)}


@pytest.mark.parametrize("most", [line_frequency.MAX_SET, 1])
def test_frequent_lines_are_removed_from_the_text(spark, most):
    body = " ".join(f"x{i}" for i in range(60))
    rows = [(i, f"Menu\n\n{body} {i}\n \nShared  LINE of the host\nmenu\n", "en", "a" if i < 12 else "b", 1) for i in range(20)]
    rows += [(20, "Menu\nshared line of the host", "en", "a", 1), (21, None, "en", "a", 1)]
    got = {r["doc_id"]: (r["text"], r["line_words"], r["kept"]) for r in line_frequency.line_quality(spark.createDataFrame(rows, DOC), max_set=most).collect()}
    want = {i: (f"\n{body} {i}\n \n", 7, True) if i < 12 else (rows[i][1], 0, True) for i in range(20)}
    assert got == want | {20: ("", 6, False), 21: (None, 0, False)}


def test_mix_comes_near_its_targets(spark):
    rows = mixing.op8_mixing(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(0.05 * own[0]["target"], 2 * max(r["size"] for r in own))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_mix_of_odd_rows(odd):
    m = mixing.mix(odd)
    assert m.count() == 9 and mixing.mix(odd.limit(0)).count() == 0
    taken = mixing.take(m)
    assert taken.count() == m.agg(F.sum("mix_copies")).first()[0] and set(taken.columns) == set(odd.columns)
    assert foreign_values(m) == {"mine"} == foreign_values(taken)


def test_mix_of_rows_without_ids_is_the_same_on_reruns(spark):
    rows = [(None, f"text {i % 3} {'word ' * (i % 7)}", "en", "a" if i % 3 else None, 1) for i in range(60)]
    again = [sorted(r["text"] for r in mixing.take(mixing.mix(spark.createDataFrame(x, DOC).repartition(p))).collect()) for p, x in ((1, rows), (5, rows[::-1]))]
    assert again[0] == again[1]


def test_decontamination_by_join_equals_the_hash_set(spark):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    both = [sorted((r["doc_id"], r["bench_words"], str(r["bench_spans"]), str(r["bench_items"])) for r in decontaminate.find_contamination(docs, items, max_set=n).collect()) for n in (100_000, 0)]
    assert both[0] == both[1]


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([("i1", "Same, words"), ("i1", "Same, words"), ("i2", None), ("i3", " ")], "item_id string, text string")
    got = decontaminate.find_contamination(odd, items).collect()
    assert sorted(len(r["bench_spans"]) for r in got) == [0] * 6 + [1] * 3 and {tuple(r["bench_items"]) for r in got} == {(), ("i1",)}
    assert decontaminate.find_contamination(odd, items.limit(0)).filter("size(bench_spans) > 0").count() == 0
    for most in (decontaminate.MAX_SET, 0):
        assert foreign_values(decontaminate.find_contamination(odd, items, max_set=most)) == {"mine"}
    without_id = spark.createDataFrame([(None, "Same, words"), (None, "in both"), ("i", "rows")], "item_id string, text string")
    for most in (decontaminate.MAX_SET, 0):
        assert {tuple(r["bench_items"]) for r in decontaminate.find_contamination(odd, without_id, max_set=most).collect()} == {(), ("i", None)}
    assert decontaminate.find_contamination(odd.limit(0), items).count() == 0


def test_shards_hold_rows_evenly(spark, odd):
    rows = sharding.op10_hilbert_sharding(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    sizes = [len(slots[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    out = sharding.shard(odd)
    assert out.count() == 9 and sharding.shard(odd.limit(0)).count() == 0 and foreign_values(out) == {"mine"}
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(odd, shards=2).collect()) == [(0, k) for k in range(5)] + [(1, k) for k in range(4)]


def test_shards_follow_the_curve_and_prune_every_dimension(spark):
    """The order against plain Python; a narrow range of any column leaves most shards out by their least and greatest values."""
    import numpy as np

    n, shards = 4000, 256
    rows = [(i * 7 % 10_007, "x" * (i * i % 997), f"l{i * 13 % 8}", f"s{i * 31 % 23:02}", 1) for i in range(n)]
    out = sharding.shard(spark.createDataFrame(rows, DOC), shards=shards)
    got = [(r["shard"], r["slot"], r["shard_key"], r["doc_id"], r["lang"], r["source"], r["shard_size"]) for r in out.collect()]
    keys = [g[2] for g in sorted(got)]
    assert keys == sorted(keys) and len(set(keys)) > shards

    def codes(values, names):
        order = {v: sum(w < v for w in values) * 16 // n for v in set(values)} if len(set(values)) > 16 else {v: k * 16 // len(set(values)) for k, v in enumerate(sorted(set(values)))}
        return np.array([order[v] for v in values])

    lang, source = codes([g[4] for g in got], True), codes([g[5] for g in got], True)
    number = [(np.array([g[k] for g in got])[:, None] >= np.array(sorted(set(np.quantile([g[k] for g in got], [q / 16 for q in range(1, 16)], method="inverted_cdf"))))).sum(1) for k in (6, 3)]
    assert (sharding.hilbert_index([lang, source, *number], 4) == np.array([g[2] for g in got])).mean() > 0.98  # cuts are approximate
    for k, some in ((3, range(5000, 5100)), (4, ["l3"]), (5, ["s05"]), (6, range(500, 520))):
        low, high = ({} for _ in range(2))
        for g in got:
            low[g[0]], high[g[0]] = min(low.get(g[0], g[k]), g[k]), max(high.get(g[0], g[k]), g[k])
        assert sum(low[s] <= max(some) and high[s] >= min(some) for s in low) < 0.5 * shards, k


def test_hilbert_neighbours_are_next_to_each_other():
    import numpy as np

    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    order = np.argsort(sharding.hilbert_index([grid[:, 0].copy(), grid[:, 1].copy()], 4))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


# ---- 6


def test_main_text_of_a_page():
    body = "".join(f"<p>Paragraph {i} of the article has quite a few words &amp; says <b>something</b> of use to its readers.</p>" for i in range(6))
    page = f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><a href='/'>Home</a> <a href='/x'>News</a></nav><article><h1>Title here</h1>{body}</article><div class='comments'><p>First comment!</p></div><footer>Copyright</footer><script>var x = 1;</script></body></html>"
    want = "\n\n".join(["Title here", *(f"Paragraph {i} of the article has quite a few words & says something of use to its readers." for i in range(6))])
    assert html_text.main_text(page) == want
    assert html_text.main_text(None) == html_text.main_text("") == ""


def test_main_text_split_over_plain_divs():
    long = [f"Paragraph {i} " + "of the article says something of use to its readers. " * 8 for i in range(10)]
    short = [f"A short paragraph {i} that belongs to the same article too." for i in range(3)]
    text, more = ("".join(f"<p>{x}</p>" for x in part) for part in (long, short))
    links = "<div class='x'><a href='/a'>One</a> | <a href='/b'>Two</a></div>"
    want = "\n\n".join(x.strip() for x in long + short)
    assert html_text.main_text(f"<body>{links}<div id='content'><div class='text'>{text}</div><div class='more'>{more}</div></div><footer>Copyright</footer></body>") == want
    assert html_text.main_text(f"<body>{links}<div><div>{text}</div></div><div><div>{more}</div></div></body>").endswith(want)
    assert html_text.main_text(f"<body><article>{text}</article><article>{more}</article></body>") == want
    assert html_text.main_text(f"<body><div>Slogan</div><div><article>{text}{more}</article></div></body>") == want


def test_main_text_in_linear_time():
    import time

    began = time.time()
    deep = "<div>" * 50_000 + "some text that lies deep" + "</div>" * 50_000
    assert html_text.main_text(deep) == "some text that lies deep"
    assert html_text.main_text("<div>" * 20_000 + "".join(f"<p>short {i}</p></section></ul>" for i in range(2000))).count("\n\n") == 1999
    assert time.time() - began < 30


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>open <b>tags"), (3, "u", ""), (3, "u", "<" * 5000), (4, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("mine")).withColumn("text", F.lit("mine"))
    out = html_text.extract(df).collect()
    assert len(out) == 5 and html_text.extract(df.limit(0)).count() == 0 and {r["text"] for r in out} == {"mine"}
    assert sorted(r["main_text"] for r in out)[-2:] == ["deep", "open tags"]


LONG = [f"Paragraph {k} goes on about the matter at hand for as long as such paragraphs do, with clauses, and ends in a full stop some way further down the line." for k in range(6)]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=x><body><nav><a href=/>Home</a></nav>{}<footer>Copyright</footer></body></html>",
        "<html><head><title>T</title><link rel=x><p></p><nav><a href=/>Home</a></nav>{}<footer>Copyright</footer></html>",
        "<body><form id=aspnet><input type=hidden><nav><a href=/>Home</a></nav><div>{}</div><div class=footer>Copyright</div></form></body>",
        "<body><nav><a href=/>Home</a><main>{}</main><footer>Copyright</footer></body>",
        "<body><nav><a href=/>Home</a></nav><div class='site-content right-sidebar'>{}</div><div class=sidebar>Read more</div></body>",
        "<body><div class='wrapper no-sidebar'>{}</div><aside>Aside of a few words</aside></body>",
        "<body><div class='no-comments entry'>{}</div><div class='comments'><p>First!</p></div></body>",
        "<body><div class='ad-free'>{}</div><div class='ad'>Buy now</div></body>",
        "<body><article class='category-social'>{}</article><div class='social-links'><a href=x>Tweet</a></div></body>",
        "<body><article id='market-share'>{}</article><div id='share-buttons'>Tell your friends</div></body>",
        "<body><header class=site-header><a href=/>Home</a><article>{}</article></header><footer>Copyright</footer></body>",
        "<body><div class='content'>{}</div><section class='comments'>" + "".join(f"<article class=comment><p>{p} says reader {k}</p></article>" for k, p in enumerate(LONG * 3)) + "</section></body>",
    ],
)
def test_op6_hints_do_not_lose_pages(page):
    """An open head, a form around a page, an open nav, and names of classes in which a word only looks like boilerplate."""
    assert html_text.main_text(page.format("".join(f"<p>{p}</p>" for p in LONG))) == "\n\n".join(LONG)


def test_op6_threshold_of_nearly_equal_values():
    import numpy as np

    values = np.nextafter(np.full(5, 150.0), [0.0, 0.0, 200.0, 200.0, 200.0])
    assert np.isfinite(html_text.threshold(values)) and np.isfinite(html_text.threshold(np.array([1.0, np.nextafter(1.0, 2.0)])))


# ---- 7


def brute_classes(texts: dict) -> dict:
    def bag(t):
        w = words(t)
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    bags = {d: bag(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d in sorted(bags):
        near = Counter()
        for s, n in bags[d].items():
            for e, m in index[s]:
                near[e] += min(n, m)
            index[s].append((d, n))
        for e, both in near.items():
            if both >= 0.8 * (sum(bags[d].values()) + sum(bags[e].values()) - both):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: find(d) for d in texts}


def test_near_duplicates_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.op7_dart_minhash(spark, SF_DIR).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_of_a_chain_and_of_open_bands(spark):
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 100 - 3 * i] + [f"z{i}{k}" for k in range(3 * i)])) for i in range(12)] + [(100 + i, " ".join(base[i : i + 60])) for i in range(30)]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 4):
        got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df, exact_after=limit).collect()}
        assert got == brute_classes(texts)


@pytest.mark.parametrize("after", [0, 4])
def test_near_duplicates_in_blocks_equal_brute_force(spark, texts, monkeypatch, after):
    """Near copies of one text that lie near the limit from each other, some of them apart, in blocks of a few texts."""
    monkeypatch.setattr(dart_minhash, "SMALL_BAND", 1)
    monkeypatch.setattr(dart_minhash, "BLOCK_TEXTS", 7)
    base, rows = [f"t{i}" for i in range(200)], []
    for i in range(150):
        w = list(base)
        for k in range(1 + i % 5):
            w[(i * 37 + k * 41) % 200] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df, exact_after=after).collect()}
    assert got == brute_classes(dict(rows))
    assert len(set(got.values())) > 20
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.op7_dart_minhash(spark, SF_DIR).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = dart_minhash.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5), (7, 7)]
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in rows) == [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (5, True), (6, False), (7, True)]
    assert dart_minhash.near_duplicates(odd.limit(0)).count() == 0
    left = dart_minhash.without_near_duplicates(odd)
    assert left.count() == 7 and set(left.columns) == set(odd.columns) and foreign_values(left) == {"mine"}


def test_recall_of_near_duplicates_by_similarity(spark):
    """Pairs of documents with a planted similarity: all at 0.8 and over are linked, none below."""
    rows, want = [], {}
    for k, (share, times) in enumerate([(0.75, 60), (0.79, 60), (0.81, 60), (0.85, 60), (0.9, 60), (1.0, 20)]):
        for i in range(times):
            base = [f"p{k}x{i}y{j}" for j in range(204)]  # 200 shingles; the last differ in the second text
            same = round(400 * share / (1 + share))
            other = base[: same + 4] + [f"q{k}x{i}y{j}" for j in range(200 - same)]
            a = 10_000 * k + 2 * i
            rows += [(a, " ".join(base)), (a + 1, " ".join(other))]
            want[a + 1] = a if share >= 0.8 else a + 1
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in want} == want


def test_substring_dedup_of_repeated_rows(spark):
    """One row very many times: its copies are dealt to all groups, and are cut whole."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring_dedup.dedup_substrings(spark.createDataFrame([(None, text)] * 500 + [(1, "alone")], "doc_id long, text string"), groups=7).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(1, 0)] + [(40, 40)] * 500


def test_substring_dedup_of_odd_rows(odd):
    rows = substring_dedup.dedup_substrings(odd).collect()
    assert len(rows) == 9 and {r["n_removed"] for r in rows if r["doc_id"] != 4} == {0}
    assert substring_dedup.dedup_substrings(odd.limit(0)).count() == 0
