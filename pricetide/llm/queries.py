"""The registered queries op1_ to op13_ over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import bagminhash, crf, idblocks, itq, lemp, mixing, nndescent, pieces, recurrent, rollups, suffixes, whitening, wrappers
from pricetide.llm.tables import settled
from pricetide.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mixture of one and a half times all sizes takes from each document."""
    size = mixing.size_of(F.col("text"))
    sized = settled(_read(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"), mixing.quality_of(F.col("text"), size).alias("quality")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, length(text) AS chars FROM documents),
drawn AS (SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / CASE WHEN chars / greatest(size, 1) BETWEEN 3.5 AND 12.0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS pick_key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM sources),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
chosen AS (SELECT arg_min(level, cap / weight) AS final FROM levels WHERE cap > level * weight),
goals AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM levels, chosen),
ranked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY pick_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
halves AS (SELECT r.doc_id, r.size, g.source_size, g.target, r.before, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole
    FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
    (whole * size + least(size, greatest(0, floor(target + 0.5)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM halves
"""


def op2_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every text, learned from the documents of six folds."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return recurrent.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = wrappers.main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9."""
    return itq.links(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over all documents: all come in; some are deleted; some are counted anew; another tokenizer version comes in;
    the second batch is sent again."""
    docs = _read(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    counted = settled(docs.select("source", "lang", fold.alias("fold"), mixing.size_of(F.col("text")).alias("words"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    gone, again = counted.filter("fold = 0"), counted.filter("fold = 1")
    totals = rollups.Rollup(spark, scratch_path(spark, "token-totals"))
    delete = [rollups.deleted(gone, "words-1", F.col("words"))]
    rollups.replay(totals, [
        ("0-load", [rollups.inserted(counted, "words-1", F.col("words"))]),
        ("1-delete", delete),
        ("2-revise", [rollups.revised(again, "words-1", F.col("words"), F.col("words") + 1)]),
        ("3-version", [rollups.inserted(counted.filter("fold <> 0"), "bytes-4", F.ceil(F.col("bytes") / 4))]),
    ])
    totals.compact()
    rollups.replay(totals, [("1-delete", delete)])
    return totals.totals()


OP5_SQL = """
WITH counted AS (SELECT source, lang, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words,
    strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
bits AS (SELECT *, encode(coalesce(doc_id::VARCHAR, '')) AS raw FROM counted),
crcs AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(raw)), lambda k: ascii(chr(ascii(substr(decode(raw), k, 1))))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM bits),
folds AS (SELECT *, xor(c, 4294967295) % 10 AS fold FROM crcs),
rows AS (
    SELECT source, lang, 'words-1' AS version, words + (fold = 1)::BIGINT AS tokens FROM folds WHERE fold <> 0
    UNION ALL SELECT source, lang, 'bytes-4', (bytes + 3) // 4 FROM folds WHERE fold <> 0)
SELECT source, lang, version, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document: exact copies, and texts that share 0.8 of their runs of five words."""
    return bagminhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest")


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents of four folds."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = crf.held_out(F.col("doc_id"), 5)
    model = crf.fit(docs.filter(~test))
    return crf.identify(docs.select("doc_id", "text", test.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text and what they decode to, as digests."""
    coded = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100."""
    return nndescent.nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that repeat an earlier passage of fifty words or more."""
    found = suffixes.repeated_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("words").alias("n_words"), removed.alias("n_removed"), "spans")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hardest rows of other labels, by inner product, for each anchor and each of its five nearest rows of the same label."""
    table = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return lemp.mine(table, F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM near p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def op12_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    found = whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    parts = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "of"), "identity_error")
    return parts.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, read back from files of patched frames."""
    path = scratch_path(spark, "token-ids")
    idblocks.write_ids(_read(spark, sf_dir, "documents").select("doc_id", "text"), BYTES, path)
    return idblocks.read_ids(spark, path).select(F.col("name").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_ALL = (
    op1_mixture, op2_likelihood, op3_main_text, op4_linked_vectors, op5_token_totals, op6_near_duplicates, op7_languages, op8_pieces, op9_neighbours,
    op10_repeats, op11_hard_negatives, op12_whitened, op13_token_files,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op1_mixture": OP1_SQL, "op5_token_totals": OP5_SQL, "op11_hard_negatives": OP11_SQL}
