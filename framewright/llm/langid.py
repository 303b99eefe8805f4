"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its training text. A text
is compressed in pieces with every dictionary; the one that makes it smallest
names the language, and a narrow margin to the second best rejects it. All of the
text is compressed; pieces keep the dictionaries, not the text itself, decisive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, others
from .sample import label_sample
from .tokens import slices

UNDETERMINED = "und"
#: Documents drawn a language, and bytes that its dictionary holds at most: bounds of the sample fitted on.
SAMPLE_DOCS = 64
DICTIONARY_BYTES = 24_000
#: Bytes compressed at once.
PIECE = 1024
LEVEL = 12
#: Below this share of the smaller size, the margin to the second best language is narrow.
NARROW = 0.005
#: The margin at which the score is about 0.73.
MARGIN_UNIT = 0.02


def fit(rows: DataFrame, lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary, from labelled rows (doc_id, text, lang). No labelled rows: no languages.

    Of a drawn text no more is fetched than the dictionary can hold, so the driver's
    memory depends on the number of languages alone.
    """
    parts: dict[str, list[bytes]] = {}
    begin = F.greatest(F.floor((F.length("text") - DICTIONARY_BYTES) / 2), F.lit(0)).cast("int") + 1
    middles = rows.withColumn("text", F.substring(rows["text"], begin, F.lit(DICTIONARY_BYTES)))
    for r in label_sample(middles, lang, SAMPLE_DOCS):
        parts.setdefault(r.label, []).append(normal(r.text))
    share = {k: max(1, DICTIONARY_BYTES // len(v)) for k, v in parts.items()}
    # Every drawn document gives a share of the dictionary, from its middle; short ones give all that they have.
    return {k: b" ".join(x[max(0, (len(x) - share[k]) // 2) :][: share[k]] for x in v) for k, v in sorted(parts.items())}


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs, self.coders = [], []
        for lang, data in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(data or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.langs.append(lang)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin. Without a letter: und, 0, 0. With one language known: that one, 1, 1."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        data = normal(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / sizes[best]
        return self.langs[best], 1 / (1 + math.exp(-margin / MARGIN_UNIT)), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, lang_score (double, 0 to 1), lang_margin (double) and rejected (margin narrow or no language).

    Null texts and texts without a letter are `und` with score 0, and rejected.
    Only `text` decides; other columns pass through, own ones of these names are
    replaced. Equal sizes go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES a language

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(shared.value)
        for column in texts:
            found = []
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"])):
                found += [model.predict(t.as_py()) for t in part.column(0)]
            langs, scores, margins = zip(*found) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["lang_pred", "lang_score", "lang_margin"])

    of = F.arrow_udf(run, "lang_pred string, lang_score double, lang_margin double", F.ArrowUDFType.SCALAR_ITER)
    found = fresh("_found", docs)
    out = docs.select(*others(docs, "lang_pred", "lang_score", "lang_margin", "rejected"), of(docs["text"]).alias(found))
    return out.select(*others(out, found), f"{found}.*").withColumn("rejected", F.col("lang_margin") < NARROW)
