"""Language identification by compression.

For each language, a zstandard raw-content dictionary holds a bounded sample of labelled text. A text is cut into blocks, each
block is compressed with every language's dictionary, and the language whose compressed sizes sum to the fewest bytes wins.
Blocks keep a long text from becoming its own dictionary. Where the runner-up is within MARGIN of the winner, the row is marked rejected.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_texts

#: The bound on what is learnt: documents a language, code points of each, dictionary bytes a language and in all.
SAMPLE_DOCS, EXCERPT, DICT_BYTES, ALL_BYTES = 1500, 600, 192 * 1024, 48 * 1024 * 1024
BLOCK, LEVEL, MARGIN = 4096, 8, 0.01
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def normalise(text: str) -> bytes:
    """Lower case; whatever isn't a letter becomes one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content for each language, the most frequent language first. labelled: key, text, lang without nulls.

    A language's sample is the SAMPLE_DOCS documents with the smallest hash of their key, EXCERPT code points from the middle of each.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    room = min(DICT_BYTES, ALL_BYTES // len(counts))
    docs = max(1, min(SAMPLE_DOCS, room // EXCERPT * 4))
    span = 1 << 30
    share = {x: min(span, -(-2 * docs * span // n)) for x, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    rank = F.pmod(F.xxhash64("key"), F.lit(span))
    middle = F.substring("text", F.greatest(F.lit(1), (F.length("text") / 2 - EXCERPT // 2).cast("int")), F.lit(EXCERPT))
    sample: dict[str, list] = {x: [] for x in counts}
    for r in labelled.select("lang", rank.alias("rank"), middle.alias("text")).where(F.col("rank") < limit).toLocalIterator():
        sample[r["lang"]].append((r["rank"], r["text"]))
    content = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        found = sample[lang]
        joined = b" ".join(dict.fromkeys(normalise(t) for _, t in sorted(found)[:docs]))
        content[lang] = joined[-room:] if joined.strip() else lang.encode()
    return content


def _classifier(content: dict[str, bytes]):
    names = list(content)
    packers = []
    for x in names:
        d = zstandard.ZstdCompressionDict(content[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def predict(text: str | None) -> tuple[str, float, bool]:
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        data = normalise(text)
        sizes = [0] * len(names)
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            for k, p in enumerate(packers):
                sizes[k] += len(p.compress(block))
        best = min(range(len(names)), key=lambda k: (sizes[k], k))
        weight = sum(2.0 ** max(-60.0, float(sizes[best] - s)) for s in sizes)
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best] + 1)
        return names[best], 1.0 / weight, (second - sizes[best]) < MARGIN * sizes[best]

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    Learns from rows that aren't held out and have text and lang; predictions see the text alone. lang_pred is `und` and score 0 for a null
    text or one without a letter, and everywhere if nothing can be learnt. Ties go to the language with more labelled rows, then to the first by name. Repeated rows keep their rows; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    usable = ~F.col("held_out") & F.col("lang").isNotNull() & (F.length("text") > 0)
    content = learn(rows.where(usable).select(F.col("doc_id").alias("key"), "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(content)  # at most ALL_BYTES

    def predictor():
        return _classifier(shared.value) if shared.value else lambda _: ("und", 0.0, True)

    return map_texts(rows.select("doc_id", "held_out", "text"), predictor, "lang_pred string, score double, rejected boolean")
