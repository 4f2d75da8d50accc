"""Language identification by compression: a text belongs to the language whose sample, as a raw-content zstandard
dictionary, makes it smallest.

Texts are lower-cased and reduced to runs of letters, and cut into blocks that are compressed alone, so that a long text
cannot teach the compressor its own words; every block of a text counts. Short texts, whose sizes in bytes tie easily,
are also compressed with parts of each dictionary. A narrow margin marks the answer as unreliable.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NOT_WORDS = re.compile(r"[\W\d_]+")
#: Word characters that are no letters by their Unicode category: numbers such as ½, ² and Ⅷ.
_NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
_NO_NUMBERS = dict.fromkeys(map(ord, _NUMBERS), " ")


def letters_of(text: str | None) -> str:
    """Runs of letters (Unicode category L, with the marks that words hold), lower-cased, one space between them."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = text.translate(_NO_NUMBERS)
    words = _NOT_WORDS.sub(" ", text).strip()
    return words if any(c.isalpha() for c in words) else ""


class Languages:
    """One dictionary for each language, and parts of it for short texts."""

    def __init__(self, samples: dict[str, bytes], level: int = 3, parts: int = 4, block: int = 4096, short: int = 768):
        self.samples, self.level, self.parts, self.block, self.short = samples, level, parts, block, short
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def _compressor(self, data: bytes):
        import zstandard as z

        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.level)
        return z.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def _prepare(self) -> None:
        self.ready = []
        for lang, data in sorted(self.samples.items()):
            n = -(-len(data) // self.parts)
            self.ready.append((lang, self._compressor(data), [self._compressor(data[k : k + n]) for k in range(0, len(data), n)]))

    def sizes(self, letters: str) -> list[tuple[float, str]]:
        """(compressed bytes, language), smallest first."""
        if self.ready is None:
            self._prepare()
        data = letters.encode("utf-8", "surrogatepass")
        blocks = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        if len(blocks) > 1 and len(blocks[-1]) < self.block // 4:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        out = []
        for lang, whole, parts in self.ready:
            size = float(sum(len(whole.compress(b)) for b in blocks))
            if len(data) <= self.short:
                size += sum(len(c.compress(data)) for c in parts) / (4 * len(parts))
            out.append((size, lang))
        return sorted(out)

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        letters = letters_of(text)
        if not letters or not self.samples:
            return "und", 0.0, False
        found = self.sizes(letters)
        best, lang = found[0]
        unit = math.sqrt(1 + len(letters) / 512)
        score = 1 / sum(math.exp(-min(50.0, (size - best) / unit)) for size, _ in found)
        second = found[1][0] if len(found) > 1 else 2 * best
        return lang, score, (second - best) / second >= narrow


def learn_languages(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_per_language: int = 120, longest: int = 32_768, dict_bytes: int = 112 << 10, most_languages: int = 200) -> Languages:
    """Dictionaries from a sample of labelled rows: about rows_per_language rows of each language, chosen by a hash of the
    id and the text, of a longer text a stretch of `longest` characters; dict_bytes of their letters are kept. Of a language
    whose sample is empty all rows are taken, up to rows_per_language of least hash. Only the most_languages languages with
    the most rows are learned. These bounds are all that is collected; they bound the sample, not what is predicted."""
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    by_lang = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in by_lang.collect()}
    if not counts:
        return Languages({})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, rows_per_language / n))])
    u = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), u.alias("u"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isin(list(counts)))
    start = F.floor(F.col("u") * F.greatest(F.length("text") - longest, F.lit(0))).cast("int") + 1  # a stretch anywhere in a long text
    drawn = drawn.withColumn("text", F.when(F.length("text") > longest, F.substring("text", start, F.lit(longest))).otherwise(F.col("text")))
    some = drawn.where(F.col("u") < F.element_at(share, F.col("lang"))).collect()
    missed = sorted(set(counts) - {r["lang"] for r in some})  # possible only where a language has few rows
    if missed:
        least = F.row_number().over(Window.partitionBy("lang").orderBy("u", "id", "text"))
        some += drawn.where(F.col("lang").isin(missed)).withColumn("k", least).where(F.col("k") <= rows_per_language).drop("k").collect()
    samples: dict[str, bytes] = {}
    for r in sorted(some, key=lambda r: (r["lang"], str(r["id"]), r["text"])):
        got = samples.get(r["lang"], b"")
        if len(got) < dict_bytes and (letters := letters_of(r["text"])):
            samples[r["lang"]] = got + letters.encode("utf-8", "surrogatepass") + b" "
    return Languages({lang: data[-dict_bytes:] for lang, data in samples.items()})


def identify_languages(docs: DataFrame, languages: Languages, narrow: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, reliable.

    A null text, an empty one and one without letters are `und`, score 0, not reliable; so is every text if nothing was
    learned. reliable: the relative margin to the second language is at least `narrow`. Equal sizes go to the language
    first in code-point order. Repeated and null ids are rows like any other; other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        m = model.value
        for batch in batches:
            found = [m.predict(text.as_py(), narrow) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "reliable"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, reliable boolean")
