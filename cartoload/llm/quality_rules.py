"""Quality rules with adaptive limits (operator 5).

Each document gets counts over its whole text. Limits are not fixed: for every language and source
the shares built from the counts go into quantile sketches, and a document is rejected where a share
lies far outside its own group. The sketch is a histogram over buckets that grow by a constant
factor: counts add up, so sketches merge in any order to the same result, and each quantile is known
to a relative error of ``ACCURACY``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import annotate, truncate_lineage, words_of

ACCURACY = 0.01
SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    pair = ids[:-1] * len(names) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)  # so that the product below stays within 64 bits
    windows = pair[:-1] * len(names) + ids[2:]
    _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
    again = often[which] > 1
    hit = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        hit[shift:len(words) - 2 + shift] |= again
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``COUNTS`` of the whole ``text``; a null text counts as empty."""
    return annotate(docs, ["text"], COUNTS,
                    lambda texts: [list(c) for c in zip(*map(text_counts, texts.to_pylist()))] or [[] for _ in range(6)])


#: Shares: (name, expression, side, furthest, events, length, quantile). A limit never lies beyond
#: ``furthest``, so that a group which is mostly junk doesn't excuse it. ``events`` of what is counted are no
#: sign of junk in a document as long as the ``quantile`` of the group's ``length``: six symbols, four repeated
#: lines, six repeats of six words each.
SHARES = [
    ("symbols", "n_symbols / n_words", "high", 1.0, 6, "words", 0.1),
    ("dup_lines", "n_dup_lines / n_lines", "high", 0.8, 4, "lines", 0.5),
    ("repeats", "n_repeat_words / n_words", "high", 0.5, 36, "words", 0.1),
    ("long_words", "word_chars / n_words", "high", 40.0, None, None, None),
    ("short_words", "word_chars / n_words", "low", 1.5, None, None, None),
]
#: Lengths that are sketched beside the shares; a document of one line has none to repeat.
LENGTHS = {"words": "n_words", "lines": "case when n_lines > 1 then n_lines end"}
LEAST_SPREAD = 0.05  # least quartile distance of word lengths, as a part of their median


def shares(counted: DataFrame) -> DataFrame:
    """One column per share and length, null where a text has no word."""
    some = F.col("n_words") > 0
    made = {name: f"cast({text.split(' / ')[0]} as double) / {text.split(' / ')[1]}" for name, text, *_ in SHARES}
    made |= {name: f"cast({text} as double)" for name, text in LENGTHS.items()}
    return counted.withColumns({f"__share_{name}": F.when(some, F.expr(text)) for name, text in made.items()})


def bucket(value, accuracy: float = ACCURACY):
    """Number of the sketch bucket of a value of 0 or more; values below 1e-6 share the lowest."""
    growth = float(np.log((1 + accuracy) / (1 - accuracy)))
    return F.ceil(F.log(F.greatest(value, F.lit(1e-6))) / F.lit(growth)).cast("int")


def bucket_value(number, accuracy: float = ACCURACY):
    growth = float(np.log((1 + accuracy) / (1 - accuracy)))
    return F.exp(number * F.lit(growth)) * F.lit(1 - accuracy)


def sketches(shared: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """``(lang, source, share, bucket, n)``. Rows of two such tables merge by adding ``n``."""
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), F.col(f"__share_{name}").alias("value")) for name in [*(s[0] for s in SHARES), *LENGTHS]]))
    return (shared.select("lang", "source", named.alias("s")).where("s.value is not null")
            .groupBy("lang", "source", F.col("s.share").alias("share"), bucket(F.col("s.value"), accuracy).alias("bucket"))
            .agg(F.count("*").alias("n")))


def quantiles(sketch: DataFrame, points: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """The named quantiles of every ``(lang, source, share)`` of a sketch.

    A sketch has at most a few thousand buckets whatever the number of documents, so its buckets are
    brought together per group.
    """
    filled = (sketch.groupBy("lang", "source", "share", "bucket").agg(F.sum("n").alias("n"))
              .groupBy("lang", "source", "share").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("bins"), F.sum("n").alias("total")))

    def at(q: float):
        needed = F.greatest(F.ceil(F.col("total") * F.lit(q)), F.lit(1))
        run = F.aggregate("bins", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("found")),
                          lambda a, b: F.struct((a.seen + b.n).alias("seen"),
                                                F.coalesce(a.found, F.when(a.seen + b.n >= needed, b.bucket)).alias("found")))
        return bucket_value(run.found, accuracy)

    return filled.select("lang", "source", "share", F.col("total").alias("n_docs"), *[at(q).alias(name) for name, q in points.items()])


def group_limits(sketch: DataFrame, width: float = 6.0, accuracy: float = ACCURACY) -> DataFrame:
    """One row per ``(lang, source)`` with a limit per share, all from the group's own quantiles.

    The limit lies ``width`` quartile distances from the median. The distance is that from the median
    to the quartile on the clean side, which junk above it doesn't stretch. Where most documents have
    none of what is counted the quartiles tie; there a limit is as far as a few events move the share
    of a document of the group's length. Word lengths differ by ``LEAST_SPREAD`` of the median at least.
    """
    q = quantiles(sketch, {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75}, accuracy)
    wide = q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("share") == name, F.struct("q10", "q25", "q50", "q75"))).alias(name)
                                             for name in [*(s[0] for s in SHARES), *LENGTHS]])
    made = []
    for name, _, side, furthest, events, length, point in SHARES:
        own = F.col(f"{name}.q50") - F.col(f"{name}.q25") if side == "high" else F.col(f"{name}.q75") - F.col(f"{name}.q50")
        least = F.lit(float(events)) / F.col(f"{length}.q{round(100 * point)}") if events else F.lit(width * LEAST_SPREAD) * F.col(f"{name}.q50")
        far = F.greatest(F.lit(width) * own, least)
        fence = F.least(F.lit(furthest), F.col(f"{name}.q50") + far) if side == "high" else F.greatest(F.lit(furthest), F.col(f"{name}.q50") - far)
        made.append(F.when(F.col(name).isNotNull(), fence).alias(f"__limit_{name}"))
    return wide.select("lang", "source", *made)


def judge(spark: SparkSession, docs: DataFrame, keep_text: bool = True, fences_of=group_limits) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; without ``text`` if it isn't to be kept.

    ``kept`` is false if ``base_failed``, or if a share lies beyond the limit of the document's
    language and source (nulls are a group of their own). The limits come from the documents that
    pass the base, by ``fences_of``. Null and empty texts have no words and fail the base; texts are counted
    whole whatever their length, so a very long one takes memory of a few times its size in its task; repeated rows are judged
    alike and all stay in the result; an empty table gives an empty result; input columns named like
    an added one are replaced. The counts are written below ``spark.checkpoint.dir`` without the texts;
    with ``keep_text`` the texts are counted a second time rather than written or moved.
    """
    counted = counts(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    slim = truncate_lineage(spark, counts(docs.select("lang", "source", "text") if keep_text else docs).withColumn("base_failed", F.expr(BASE_FAILED)).drop("text"), "counts")
    # Written, so that the planner knows the size of the table of limits before texts would move for it.
    fences = truncate_lineage(spark, fences_of(sketches(shares(slim).where("not base_failed"))), "limits").withColumnsRenamed({"lang": "__fence_lang", "source": "__fence_source"})
    counted = counted if keep_text else slim
    shared = shares(counted)
    within = F.lit(True)
    for name, _, side, *_ in SHARES:
        inside = F.col(f"__share_{name}") <= F.col(f"__limit_{name}") if side == "high" else F.col(f"__share_{name}") >= F.col(f"__limit_{name}")
        within = within & F.coalesce(inside, F.lit(True))
    same = F.col("lang").eqNullSafe(F.col("__fence_lang")) & F.col("source").eqNullSafe(F.col("__fence_source"))
    return shared.join(fences, same, "left").select(*[F.col(f"`{c}`") for c in counted.columns if c.lower() != "kept"], (~F.col("base_failed") & within).alias("kept"))
