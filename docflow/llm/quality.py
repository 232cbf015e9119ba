"""Quality rules by tokeniser fertility.

Public vocabularies measure each text: characters per token, the share of tokens that fall back to single bytes, and the
entropy of the text's tokens. Each measure has a rejection band, which the corpus itself sets: the quartiles of all
distinct measures of texts that pass the base rules, by language and octave of token numbers (entropy grows with length),
and fences beyond them by multiples of the distance between the quartiles. An octave with too few texts (SUPPORT) has the
band of the next shorter one, whose entropy is no higher. A language without any such band takes that of its script, then
that of the whole corpus, and where there is none, the script's fixed limits.
The base rules (too few words, too many repeated three-word windows) come first.

The first pass goes through the texts, with a bounded cache of words' tokens, and writes narrow rows (or, in `keep`, the
documents with their measures); quartiles come from histograms in steps of a thousandth, combined in each task and read by parts; the bands
are one row for each language and octave, joined back. Texts are not shuffled.

Defined results: null and empty texts have no words and fail the base rules; a text without tokens is not measured; texts
of any length are measured whole; a null or unknown language gets the band of its script; repeated rows are judged alike and
count once for the quartiles; a measure that lies on a fence is kept; an empty table gives an empty result; other columns
pass through whatever their names, but for those that begin with two underscores.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.shared import arrow_schema, discard, id_of, materialize, slices, table_of, text_of, tidy

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
BATCH_BYTES = 4 << 20
CACHE_WORDS = 200_000
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Distinct texts that a language (or script) needs in an octave to have a band of its own.
SUPPORT = 30
#: Steps of the histograms to 1 (a bit, a character, the whole share).
STEPS = 1000
#: Steps of a part of a histogram.
PART = 64
#: The last octave of token numbers that has a band.
OCTAVES = 40
#: Fences: how many distances between the quartiles lie beyond them, and the least distance that is counted, so that many near copies cannot close a band.
REACH = {"chars_per_token": 4.0, "byte_share": 4.0, "entropy": 2.5}
LEAST_SPREAD = {"chars_per_token": 0.05, "byte_share": 0.0125, "entropy": 0.1}
#: Limits where the corpus has too few texts to set any, by script: least and most characters per token, most byte share, least entropy.
LIMITS = {"latin": (1.2, 7.0, 0.35, 3.5), "cyrillic": (0.9, 6.0, 0.35, 3.5), "greek": (0.6, 5.0, 0.60, 3.0), "cjk": (0.3, 3.0, 0.95, 2.5), "other": (0.2, 8.0, 0.60, 2.5)}
# Blocks of the scripts above, as inclusive ranges of code points.
SCRIPT_RANGES = (("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF))

BASE = table_of("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string")
OF_VOCABULARY = table_of("n_tokens long, chars_per_token double, byte_share double, entropy double")


def measures_of(vocabularies: int) -> T.StructType:
    """The columns that a text's measures have: BASE, and OF_VOCABULARY for each vocabulary, numbered from 1."""
    return T.StructType([*BASE.fields, *(T.StructField(f"{f.name}_{k + 1}", f.dataType) for k in range(vocabularies) for f in OF_VOCABULARY)])


def script_of(text: str) -> str:
    if text.isascii():
        return "latin" if text.lower() != text.upper() else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = Counter()
    for script, first, last in SCRIPT_RANGES:
        counts[script] += int(((points >= first) & (points <= last)).sum())
    script, n = counts.most_common(1)[0]
    return script if n else "other"


class Fertility:
    """Tokens of words by one vocabulary (a sentencepiece model, or tiktoken ranks), remembered up to a bound; one instance lives in each Python worker."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            from docflow.llm.bpe import load_ranks

            ranks = load_ranks(path)
            model = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [model.encode_ordinary(f" {w}") for w in words]
            self.is_byte = np.zeros(max(ranks.values(), default=-1) + 1, bool)
            self.is_byte[[i for piece, i in ranks.items() if len(piece) == 1 and piece[0] > 127]] = True
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: model.encode(words, num_threads=1)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: Iterable[bytes]) -> None:
        """Adds the words that are not known yet, all at once."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.index]
        if not new:
            return
        found = self.encode(b" ".join(new).decode("utf-8", "surrogatepass").split(" "))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(found), np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])

    def words(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words that have been learnt."""
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.offsets[numbers + 1] - self.offsets[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[numbers] - (ends - counts), counts)
        return self.pool[at]


@lru_cache(4)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(numbers) < 4:
        return 0
    if numbers.max() >= 1 << 21:
        numbers = np.unique(numbers, return_inverse=True)[1]
    if numbers.max() < 1 << 21:
        windows = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        pairs = np.unique((numbers[:-2] << 32) | numbers[1:-1], return_inverse=True)[1]
        windows = (pairs << 32) | numbers[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(len(numbers), bool)
    for k in range(3):
        marked[k : len(numbers) - 2 + k] |= twice
    return int(marked.sum())


def measured_all(texts: list[str], vocabularies: list[Fertility]) -> list[tuple]:
    """The measures of each text of a batch. A word of the batch is looked up once, whatever the number of vocabularies; these see distinct words only."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    words = list(set(itertools.chain.from_iterable(split)))
    index = dict(zip(words, range(len(words))))
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    numbers = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(split)), np.int64, ends[-1] if len(ends) else 0)
    known = []
    for vocabulary in vocabularies:
        vocabulary.learn(words)
        known.append((vocabulary, vocabulary.words(words)))
    return [_measured(t, numbers[end - len(w) : end], known) for t, w, end in zip(texts, split, ends.tolist())]


def _measured(text: str, numbers: np.ndarray, known: list[tuple[Fertility, np.ndarray]]) -> tuple:
    """The measures of a text. numbers: its words, by their places in the batch's distinct words; known: each vocabulary's numbers of those."""
    n = len(numbers)
    if not n:
        return 0, 0, 0, 0, 0, True, "other", *(0, None, None, None) * len(known)
    raw = text.encode("utf-8", "surrogatepass")
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    duplicates = sum(k - 1 for line, k in Counter(text.split("\n")).items() if k > 1 and line.encode("utf-8", "surrogatepass").split())
    repeated = repeated_words(numbers)
    found = []
    for vocabulary, own in known:
        tokens = vocabulary.tokens(own[numbers])
        if not len(tokens):
            found += [0, None, None, None]
            continue
        shares = np.unique(tokens, return_counts=True)[1] / len(tokens)
        found += [len(tokens), word_chars / len(tokens), float(vocabulary.is_byte[tokens].mean()), float(-(shares * np.log2(shares)).sum())]
    return n, word_chars, n_symbols, duplicates, repeated, n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n, script_of(text), *found


def measured(docs: DataFrame, vocabulary_paths: list[str], text: str, prefix: str = "", carried: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) of docs, and each text's measures."""
    source = docs if dict(docs.dtypes)[text] == "string" else docs.withColumn("__text", text_of(text))
    read = text if source is docs else "__text"
    carried = docs.columns if carried is None else carried
    added = measures_of(len(vocabulary_paths))
    schema = T.StructType([*(source.schema[c] for c in carried), *(T.StructField(f"{prefix}{f.name}", f.dataType) for f in added)])
    arrow, types = arrow_schema(schema), list(arrow_schema(added).types)

    def run(batches):
        vocabularies = [fertility(p) for p in vocabulary_paths]
        for whole in batches:
            for batch in slices(whole, read, BATCH_BYTES):
                column = dict(zip(batch.schema.names, batch.columns))
                rows = measured_all([t or "" for t in column[read].to_pylist()], vocabularies)
                yield pa.RecordBatch.from_arrays([*(column[c] for c in carried), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], schema=arrow)

    return source.mapInArrow(tidy(run, fertility.cache_clear), schema)


def _octave(prefix: str = "") -> Column:
    return F.floor(F.log2(F.col(f"{prefix}n_tokens_1"))).cast("int")


def bands(rows: DataFrame, vocabularies: int) -> DataFrame:
    """A table: level (a language "l:en", a script "s:latin", or "*"), octave, band (the fences of each measure: least_*, most_*). rows: lang and measures."""
    names = [f"{m}_{k + 1}" for k in range(vocabularies) for m in REACH]
    told = rows.where(~F.col("base_failed") & (F.col("n_tokens_1") > 0)).select("lang", "script", _octave().alias("octave"), *names).distinct()
    levels = F.array(F.concat(F.lit("l:"), F.lower("lang")), F.concat(F.lit("s:"), "script"), F.lit("*"))
    # histograms in steps, counted in each task first; a quartile is the least step that a quarter (three quarters) do not exceed
    step = lambda c: F.floor(F.col(c) * STEPS + 0.5).cast("int")
    each = told.select(F.explode(levels).alias("level"), "octave", F.array(*map(step, names)).alias("steps")).where("level IS NOT NULL")
    counts = each.select("level", "octave", F.posexplode("steps").alias("k", "step")).groupBy("level", "octave", "k", "step").agg(F.count("*").alias("n"))
    histogram = materialize(counts.withColumn("part", F.floor(F.col("step") / PART).cast("int")), "quality-histogram")
    # the part of the histogram that holds a quartile first, then the step within that part: no task reads a whole histogram
    group, within = Window.partitionBy("level", "octave", "k"), Window.partitionBy("level", "octave", "k", "part", "quarter")
    parts = histogram.groupBy("level", "octave", "k", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(group.orderBy("part"))).withColumn("all", F.sum("n").over(group))
    ranks = parts.where(F.col("all") >= SUPPORT).withColumn("quarter", F.explode(F.array(F.lit(1), F.lit(3)))).withColumn("rank", F.ceil(F.col("all") * F.col("quarter") / 4))
    places = ranks.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select("level", "octave", "k", "part", "quarter", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    steps = histogram.join(places, ["level", "octave", "k", "part"]).withColumn("upto", F.sum("n").over(within.orderBy("step")))
    least = lambda k, quarter: F.min(F.when((F.col("k") == k) & (F.col("quarter") == quarter) & (F.col("upto") >= F.col("rank")), F.col("step"))) / STEPS
    quartiles = steps.groupBy("level", "octave").agg(*(F.array(least(k, 1), least(k, 3)).alias(c) for k, c in enumerate(names)))

    def fence(name: str, upper: bool) -> Column:
        measure = name.rsplit("_", 1)[0]
        spread = F.greatest(F.col(name)[1] - F.col(name)[0], F.lit(LEAST_SPREAD[measure])) * REACH[measure]
        return F.col(name)[1] + spread if upper else F.col(name)[0] - spread

    own = quartiles.select("level", "octave", F.struct(*(fence(c, False).alias(f"least_{c}") for c in names), *(fence(c, True).alias(f"most_{c}") for c in names)).alias("band"))
    every = own.select("level").distinct().select("level", F.explode(F.sequence(F.lit(0), F.lit(OCTAVES))).alias("octave"))
    shorter = Window.partitionBy("level").orderBy("octave")  # one row for each octave
    found = materialize(every.join(own, ["level", "octave"], "left").select("level", "octave", F.last("band", True).over(shorter).alias("band")).where("band IS NOT NULL"), "quality-bands")
    discard(histogram)
    return found


def judged(rows: DataFrame, fences: DataFrame, vocabularies: int, prefix: str = "", lang: str = "lang") -> DataFrame:
    """rows with __kept. Bands of the language come before those of its script, and those before the corpus's; the fixed limits are last."""
    names = [f"{m}_{k + 1}" for k in range(vocabularies) for m in REACH]
    keys = {"__l": F.concat(F.lit("l:"), F.lower(F.col(lang))), "__s": F.concat(F.lit("s:"), F.col(f"{prefix}script")), "__a": F.lit("*")}
    found = rows.withColumn("__octave", _octave(prefix))
    for name, key in keys.items():
        found = found.withColumn("__level", key).join(fences.select(F.col("level").alias("__level"), F.col("octave").alias("__octave"), F.col("band").alias(name)), ["__level", "__octave"], "left").drop("__level")
    of_script = F.create_map(*(x for script, limits in LIMITS.items() for x in (F.lit(script), F.array(*map(F.lit, limits)))))
    found = found.withColumn("__band", F.coalesce(*map(F.col, keys))).withColumn("__limits", of_script[F.col(f"{prefix}script")])
    good = ~F.col(f"{prefix}base_failed")
    for c in names:
        value, measure = F.col(f"{prefix}{c}"), c.rsplit("_", 1)[0]
        low = {"chars_per_token": F.col("__limits")[0], "entropy": F.col("__limits")[3]}.get(measure)
        high = {"chars_per_token": F.col("__limits")[1], "byte_share": F.col("__limits")[2]}.get(measure)
        if low is not None:
            good &= value >= F.coalesce(F.col("__band")[f"least_{c}"], low)
        if high is not None:
            good &= value <= F.coalesce(F.col("__band")[f"most_{c}"], high)
    return found.withColumn("__kept", F.coalesce(good, F.lit(False))).drop(*keys, "__octave", "__band", "__limits")


def _language(docs: DataFrame, lang: str) -> Column:
    return F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")


def measure(docs: DataFrame, vocabulary_paths: list[str], text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, the base columns, kept, script and the measures of each vocabulary."""
    n = len(vocabulary_paths)
    rows = docs.select(id_of(doc_id).alias("doc_id"), _language(docs, lang).alias("lang"), text_of(text).alias("text"))
    rows = materialize(measured(rows, vocabulary_paths, "text", carried=["doc_id", "lang"]), "quality-measures")
    fences = bands(rows, n)
    names = measures_of(n).names
    return judged(rows, fences, n).select("doc_id", *names[:6], F.col("__kept").alias("kept"), *names[6:])


def keep(docs: DataFrame, vocabulary_paths: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that pass, with the columns of docs; the text is measured where it lies."""
    n = len(vocabulary_paths)
    rows = materialize(measured(docs.withColumn("__lang", _language(docs, lang)), vocabulary_paths, text, "__"), "quality-rows")
    narrow = rows.select(F.col("__lang").alias("lang"), *(F.col(f"__{c}").alias(c) for c in measures_of(n).names))
    fences = bands(narrow, n)
    result = materialize(judged(rows, fences, n, "__", "__lang").where("__kept").select(docs.columns), "quality-kept")
    discard(rows, fences)
    return result
