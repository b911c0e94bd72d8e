"""The training-data operators against the library, brute force and round trips, with nulls, empty texts, ties, repeated rows and empty tables."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.llm import bagminhash, crf, itq, mixing, nndescent, pieces, recurrent, rollups, suffixes, wrappers
from pricetide.llm.queries import PIECES
from pricetide.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(3)
PASSAGE = " ".join(f"shared{k}" for k in range(60))
BASE = [f"w{k}" for k in RNG.integers(0, 300, 200)]


def near(changes: int) -> str:
    words = list(BASE)
    for k in range(changes):
        words[k * 20 % 200] = f"x{changes}-{k}"
    return " ".join(words)


TEXTS = [None, "", " \n", "one", "one", "a b c", near(0), near(0), near(2), near(9), PASSAGE, f"before {PASSAGE} after", f"{PASSAGE} {PASSAGE}", "the end " * 400, "naïve 中文 \t tab", "9 9 9"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k % 4}" if k % 5 else None, k) for k, t in enumerate(TEXTS)] + [(None, "null id", "en", "s1", 0), (6, TEXTS[6], "en", "s2", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node long")


def test_pieces_equal_the_library(spark, docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    letters = list("ab th\nér▁中𝄞1.")
    random = ["".join(RNG.choice(letters, RNG.integers(1, 700))) for _ in range(100)]
    df = docs.select("text").unionAll(spark.createDataFrame([(t,) for t in random], "text string"))
    for r in pieces.encode(df, PIECES).collect():
        want = model.encode(r["text"] or "", add_eos=True)
        assert (r["ids"], r["decoded"]) == (want, model.decode(want))
    assert pieces.encode(docs.limit(0), PIECES).count() == 0


def test_languages_of_words_and_texts(spark, docs):
    en, de = "the and of with from that", "der und von mit aus das"
    mixed = spark.createDataFrame([(k, " ".join(RNG.choice((en if k % 2 else de).split(), 30)), "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string")
    model = crf.fit(mixed.filter("doc_id < 40"))
    got = crf.identify(mixed.filter("doc_id >= 40"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)
    p, _, _ = crf.label_words(model, pa.array([f"{en} {en} {de} {de}"]))
    assert (p.argmax(1) == [1] * 12 + [0] * 12).all()
    found = {r["text"]: (r["lang_pred"], r["score"]) for r in crf.identify(docs, model).collect()}
    assert found[None] == found[""] == found["9 9 9"] == ("und", 0.0)
    assert {r["lang_pred"] for r in crf.identify(docs, crf.fit(mixed.limit(0))).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    from itertools import product

    emit, moves = RNG.normal(size=(4, 3)).astype(np.float64), RNG.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        weight = np.exp(sum(emit[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            want[t, y] += weight
    assert np.allclose(crf.marginals(emit, np.array([0, 4]), moves), want / want.sum(1, keepdims=True))


def bag(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    group = {k: k for k in range(len(rows))}
    for i, a in enumerate(rows):
        for j in range(i):
            x, y = bag(a["text"]), bag(rows[j]["text"])
            if x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    got = bagminhash.near_duplicates(docs).collect()
    want = sorted((str(r["doc_id"]), str(min((rows[k]["doc_id"] for k in group if group[k] == group[i] and rows[k]["doc_id"] is not None), default=None))) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_with_a_run_above_4096_times(spark):
    texts = ["again " * 10_000, "again " * 9_994, "line " * 5_004, "line  " * 5_004, "again " * 5_000]
    got = bagminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(got)] == [0, 0, 2, 2, 4]


def test_signatures_are_unbiased_for_weights():
    texts = [" ".join(BASE + BASE[: 5 * k]) for k in range(40)]
    owner, code, weight = bagminhash.bags(pa.array(texts))
    s = bagminhash.signatures(owner, code, weight, 40, 256)
    off = []
    for k in range(39):
        x, y = bag(texts[k]), bag(texts[k + 1])
        off.append((s[k] == s[k + 1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(off)) < 0.01


def test_repeats_equal_brute_force(spark, docs):
    seen, want = {}, {}
    for k, text in enumerate(TEXTS):
        words, cover = WORD.findall(text or ""), set()
        for at in range(len(words) - 49):
            if seen.setdefault(tuple(words[at : at + 50]), (k, at)) != (k, at):
                cover |= set(range(at, at + 50))
        want[k] = cover
    found = suffixes.repeated_spans(docs)
    got = {r["doc_id"]: {w for s in r["spans"] for w in range(s["start"], s["end"])} for r in found.collect()}
    assert {k: got[k] for k in want} == want
    cut = {r["doc_id"]: r["text"] for r in suffixes.without_spans(docs, found).collect()}
    assert cut[11] == "before after" and cut[10] == PASSAGE and cut[0] is None and cut[7] == ""
    assert suffixes.repeated_spans(docs.limit(0)).count() == 0


def test_mixture_meets_its_targets(spark, docs):
    size = mixing.size_of(F.col("text"))
    sized = docs.withColumn("size", size).withColumn("quality", mixing.quality_of(F.col("text"), size))
    got = mixing.mix(sized).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert sorted(map(str, mixing.mix(sized).collect())) == sorted(map(str, got))
    assert mixing.mix(sized.limit(0)).count() == 0


def test_budget_batches_count_once(spark):
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", None), (None, None, 7)], "source string, lang string, n long")
    totals = rollups.Rollup(spark, scratch_path(spark, "totals"))
    batches = [("1", [rollups.inserted(rows, "v", F.col("n"))]), ("2", [rollups.deleted(rows.filter("source IS NULL"), "v", F.col("n"))]), ("3", [rollups.revised(rows.filter("n = 5"), "v", F.col("n"), F.lit(9))])]
    assert rollups.replay(totals, batches) == [True] * 3
    totals.compact()
    assert rollups.replay(totals, batches) == [False] * 3
    assert [tuple(r) for r in totals.totals().collect()] == [("a", "en", "v", 2, 9)]


def test_main_text(spark):
    shell = '<html><head><title>t</title><script>if(a<b)"</p>"</script></head><body class="sidebar"><nav>m</nav>{}<div class="ad">x</div><footer>f</footer>'
    pages = [(k, "http://h.example/x", shell.format(f"<article><h1>T &amp;  {k}</h1><p>Own\n text {k}<br><p>Sign up now<div class=comments><p>c</div></article>")) for k in range(12)]
    rows = [*pages, (50, None, None), (51, "x", ""), (52, "http://i.example", "plain &lt; text <i>it</i>"), (53, "http://i.example", "<nav>only</nav>")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T & 3\n\nOwn text 3" and got[50] == got[51] == got[53] == "" and got[52] == "plain < text it"


def test_main_text_without_long_lists_and_notices(spark):
    menu = "".join(f"<li>Entry {k}</li>" for k in range(12))
    page = "<body><div><ul>{}</ul></div><div>{}<p>Sign up now</p>{}</div></body>"
    own = lambda k, some: "".join(f"<p>Own {k} {j}</p>" for j in some)
    rows = [(k, "http://j.example/x", page.format(menu, own(k, range(k)), own(k, range(k, 30)))) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n\n".join(f"Own {k} {j}" for j in range(30)) for k in range(12)}


@pytest.fixture(scope="module")
def vectors(spark):
    x = RNG.normal(size=(300, 16))
    x[100:140] = x[100] + RNG.normal(size=(40, 16)) * 0.03
    x[141] = x[140]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None] * 8), (905, [1.0])]
    rows = [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), np.array([r[1] for r in rows])


def test_linked_vectors_equal_brute_force(vectors):
    df, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    got = {r["vec_id"]: r for r in itq.links(df).collect()}
    assert all(got[k]["n_links"] == linked[k].sum() - 1 for k in range(300))
    assert {got[k]["component_id"] for k in range(100, 140)} == {100} and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906))
    assert itq.links(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [17, 22, 24])
def test_links_are_found_with_the_substrings_of_large_tables(spark, bits):
    rng = np.random.default_rng(bits)
    x, off = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off -= (off * x).sum(1, keepdims=True) * x
    c = rng.uniform(0.9001, 0.92, (1000, 1))
    y = c * x + np.sqrt(1 - c * c) * off / np.linalg.norm(off, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    got = itq.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bits=bits).collect()
    assert sum(r["component_id"] == r["vec_id"] % 1000 for r in got) >= 2000 - 15


def test_nearest_vectors_are_found(vectors):
    df, x = vectors
    got = nndescent.nearest(df, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(d)[:10]))
    assert len(got) == 30 and hits >= 27
    assert nndescent.nearest(df.limit(0), F.lit(True)).count() == 0


def test_likelihood(docs):
    got = recurrent.score(docs, F.col("doc_id") == 3, rounds=1, share=1.0).collect()
    train = [r for r in docs.collect() if r["doc_id"] != 3]
    lower = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(w for r in train for w in lower(r["text"]))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == docs.count()
    for r in got:
        text = lower("null id" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert r["n_tokens"] == len(text) and np.isfinite(r["score"])
        if r["doc_id"] is not None:
            assert r["held_out"] == (r["doc_id"] == 3) and abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in text)) < 1e-6
    assert recurrent.score(docs.limit(0), F.lit(False)).count() == 0


def test_likelihood_learns_from_all_training_texts(spark, monkeypatch):
    rows = [(None if k % 2 else k, f"text {k} of {k % 7} words") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, rounds = recurrent._trained, []

    def spied(train, v, net, pick):
        rounds.append([r["text"] for r in train.filter(pick).collect()])
        return real(train, v, net, pick)

    monkeypatch.setattr(recurrent, "_trained", spied)
    got = recurrent.score(docs, F.coalesce("doc_id", F.lit(1)) % 10 == 0).collect()
    assert sorted(sum(rounds, [])) == sorted(t for k, t in rows if k is None or k % 10)
    # Texts without an id are in all rounds.
    assert all(any(int(t.split()[1]) % 2 for t in r) for r in rounds) and all(np.isfinite(r["score"]) for r in got)


def article(*paragraphs, around="{}"):
    return "<html><body>" + around.format("".join(f"<p>{p}</p>" for p in paragraphs)) + "</body></html>"


@pytest.mark.parametrize("name", ["content no-sidebar", "entry hide-comments", "share-price-table", "contentSidebar wide"])
def test_main_text_under_names_that_only_sound_like_others(name):
    assert wrappers.extract(article("T", "Main text here", around=f'<div class="{name}">{{}}</div>'), set()) == "T\n\nMain text here"


def test_main_text_without_elements_whose_names_tell():
    page = '<body><div class="site-footer">foot</div><div id="cookieNotice">we use cookies</div><div class="related-posts">more</div><article><p>One two three four five six seven.</p><section class="legal"><p>Its law.</p></section><div class="share-buttons">share it</div></article></body>'
    assert wrappers.extract(page, set()) == "One two three four five six seven.\n\nIts law."


def test_main_text_of_deep_and_long_pages(spark):
    deep = "<div>" * 6000 + "<p>at the bottom</p>" + "</div>" * 6000
    long = article(*[f"paragraph {k} of many" for k in range(20_000)])
    rows = [(k, "http://h/x", page, "a", "b", 1) for k, page in enumerate([deep, long, deep, None, "", *[deep] * 8])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _template string, host_0 int")
    got = {r["page_id"]: r for r in wrappers.main_text(df).collect()}
    assert got[0]["text"] == got[2]["text"] == "at the bottom" and got[3]["text"] == got[4]["text"] == "" and got[0]["_host"] == "a"
    assert got[1]["text"].count("\n\n") == 19_999
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_main_text_of_near_copies_of_one_article(spark):
    body = [f"Paragraph {k} of the article, with words enough to count." for k in range(5)]
    pages = [(k, "http://same/x", article(*body, f"Seen on day {k}", around="<article>{}</article>")) for k in range(12)]
    for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert r["text"] == "\n\n".join([*body, f"Seen on day {r['page_id']}"])


def test_pair_marginals_equal_the_sum_over_paths():
    from itertools import product

    emit, moves = RNG.normal(0, 2, (4, 3)), RNG.normal(0, 1, (3, 3))
    weight = {path: np.exp(sum(emit[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))) for path in product(range(3), repeat=4)}
    p, ahead, behind = crf.forward_backward(emit, np.array([0, 4]), moves)
    got = crf.pair_marginals(emit, ahead, behind, moves, np.arange(1, 4))
    for t in range(3):
        for a, b in product(range(3), repeat=2):
            assert abs(got[t, a, b] - sum(w for path, w in weight.items() if path[t : t + 2] == (a, b)) / sum(weight.values())) < 1e-12
    np.testing.assert_allclose(got.sum(2), p[:-1], rtol=1e-9)


def test_languages_of_long_texts_only_and_of_rare_letters(spark):
    long = [(k, " ".join(RNG.choice(("uno dos tres cuatro" if k % 2 else "eins zwei drei vier").split(), 3000)), "es" if k % 2 else "de") for k in range(20)]
    model = crf.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "es"]
    got = crf.identify(spark.createDataFrame([(1, "dos tres"), (2, "ª º"), (3, "µ"), (4, "7 §")], "doc_id long, text string"), model).collect()
    assert got[0]["lang_pred"] == "es" and got[1]["lang_pred"] != "und" and got[2]["lang_pred"] != "und" and got[3]["lang_pred"] == "und"


def test_rollups_compact_what_they_list_and_finish_others_commits(spark):
    one = lambda n: rollups.inserted(spark.createDataFrame([("s", "en", n)], "source string, lang string, n long"), "v", F.col("n"))
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    total = lambda: (lambda r: (r["documents"], r["tokens"]))(rollup.totals().first())
    assert rollup.commit("a", one(5))
    listed = rollup._names

    def and_then(folder):  # another writer commits right after the listing
        names = listed(folder)
        if folder == "batches" and "b" not in names:
            rollups.Rollup(spark, rollup.path).commit("b", one(5))
        return names

    rollup._names = and_then
    assert rollup.compact()
    rollup._names = listed
    assert total() == (2, 10)
    assert rollup.compact() and total() == (2, 10) and rollup._names("batches") == ["b"]
    assert rollup.compact() and rollup._names("batches") == [] and total() == (2, 10)
    assert not rollup.commit("a", one(5)) and not rollup.commit("b", one(9)) and total() == (2, 10)
    # A writer that died between its claim and its rename: whoever comes next finishes it.
    staged = f"{rollup.path}/staged/c-dead"
    one(7).groupBy(*rollups.GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(staged)
    rename, rollup._rename = rollup._rename, lambda a, b: None
    assert rollup._place(staged, f"{rollup.path}/batches/c", f"{rollup.path}/claims/c")
    rollup._rename = rename
    assert total() == (2, 10) and not rollup.commit("c", one(7)) and total() == (3, 17)
    empty = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    assert empty.totals().count() == 0 and empty.compact() and empty.commit("none", one(1).limit(0)) and empty.totals().count() == 0


def test_likelihood_beats_the_counts_on_held_out_texts(spark):
    """With production parameters, over all given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = recurrent.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    r = got.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r["n"] > 10_000 and r["s"] > 0.99 * r["b"]


def test_weights_of_many_tasks_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "FAN_IN", 3)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c a b c a b c d"), F.col("id") % 7).alias("text")).repartition(14)
    got = recurrent.score(docs, F.lit(False)).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_likelihood_of_a_very_long_text_and_of_clashing_columns(spark):
    rows = [(1, "a b " * 60_000, 1, True), (2, "a b", 2, False)]
    got = {r["doc_id"]: r for r in recurrent.score(spark.createDataFrame(rows, "doc_id long, text string, row int, held_out boolean"), F.col("doc_id") == 2).collect()}
    assert got[1]["n_tokens"] == 120_001 and np.isfinite(got[1]["score"]) and got[2]["held_out"]
