"""Language identification by compression: the language whose dictionary encodes a text shortest.

Each language has a raw-content zstandard dictionary of its own: passages from
anywhere in training texts, at most `per_text` letters of each and
`dictionary_bytes` in all. A text, lower-cased and reduced to its words, is encoded whole with every
dictionary, in blocks so short that each can refer to all of it; the smallest sum
of sizes wins, and a narrow margin is reported as rejected.
The fast strategy with short matches suits this best: it seldom learns from the
text itself, so the size tells how much of it the dictionary knows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Bytes that are encoded at once: well below the window, past which a coder forgets its dictionary.
BLOCK = 1 << 16


def letters(text: str | None) -> str:
    """The text's words of letters (Unicode category L) in lower case, joined by one space; empty if it has no letter."""
    if not text:
        return ""
    words = ["".join(filter(str.isalpha, w)) if not w.isalpha() else w for w in WORD.findall(text.lower())]
    return " ".join(filter(None, words))


def train(spark: SparkSession, docs: DataFrame, where: Column, dictionary_bytes: int = 16384, per_text: int = 512, max_languages: int = 1000) -> dict[str, bytes]:
    """A dictionary per value of `lang`, from a bounded sample of the rows that `where` keeps.

    The sample takes, per language, the rows with the smallest hashes of id and
    text, about eight times as many as fill the dictionary, and of each a passage
    of `per_text` letters that begins at a hashed place of the text. Repeated rows
    count once. Every language is learned, however little text it has; of more
    than `max_languages`, as many of the commonest.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.xxhash64("doc_id", "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return {}
    want = 4 * max(1, dictionary_bytes // per_text)
    shares = [(r["lang"], int((1 << 40) * min(1.0, 2 * want / max(r["n"], 1))) + 1) for r in counts]
    share = spark.createDataFrame(shares, "lang string, share long")
    drawn = labelled.withColumn("lot", F.pmod(hashed, F.lit(1 << 40))).join(F.broadcast(share), "lang").where("lot < share")  # max_languages rows
    width = F.lit(4 * per_text)
    start = F.pmod(F.xxhash64(hashed), F.greatest(F.lit(1), F.length("text") - width + 1)).cast("int") + 1
    drawn = drawn.select("lang", "lot", F.substr("text", start, width).alias("text")).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["lot"], r["text"])):
        held = out.setdefault(r["lang"], b"")
        if len(held) < dictionary_bytes:
            out[r["lang"]] = (held + b" " + letters(r["text"])[:per_text].encode())[:dictionary_bytes]
    return {k: v.ljust(8) for k, v in out.items()}  # a raw dictionary has 8 bytes at least


def coders(dictionaries: dict[str, bytes]) -> dict:
    import zstandard as z

    how = z.ZstdCompressionParameters(strategy=z.STRATEGY_FAST, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=3, target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)
    return {k: z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(v, dict_type=z.DICT_TYPE_RAWCONTENT)) for k, v in sorted(dictionaries.items())}


def classify(text: str | None, by: dict, margin: float = 0.01) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is 0.5 for a tie and nears 1 as the runner-up gets longer."""
    data = letters(text).encode()
    if not data or not by:
        return UNDETERMINED, 0.0, True
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, c in by.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    gap = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], 1 - 0.5 * (1 - gap) ** 20, gap < margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of `docs`.

    A null text, or one without a letter, gives ('und', 0, rejected). Ties go to
    the language whose name sorts first, and are rejected. Other columns of
    `docs` are neither read nor needed.
    """

    def work(batches):
        by = coders(dictionaries)
        for b in batches:
            found = [classify(t.as_py(), by, margin) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")
