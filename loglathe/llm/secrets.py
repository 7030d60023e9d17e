"""Secret scans: known shapes by pattern, and strings that look random by a battery of tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.llm.quality import bound
from loglathe.llm.tables import Tables, set_apart

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs of fewer characters match nothing that would be kept, and a run's longest match is the only one in it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: Expected share of false ones among the random strings that are reported.
FALSE_SHARE = 0.05
#: Chance with which a truly random string is turned away by one of the three tests.
TURNED_AWAY = 0.001
#: Bins to a power of ten in which chances are counted.
BINS = 20
#: Length from which a string has full weight in the false-discovery control; shorter ones have less, in proportion.
FULL_WEIGHT = 64
#: Share of a-f among the letters of ordinary strings, at most.
A_TO_F = 0.4
#: Serial correlation of neighbouring letters in ordinary words, vowels numbered first; in random strings it is 0.
ORDINARY_SERIAL = -0.15
#: Spread of coincidences that comes from ordinary letters' unequal shares, over the square of their coincidence.
UNEVEN = 0.26

_VOWELS, _CONSONANTS, _DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789"
_LOWER = _VOWELS + _CONSONANTS
_UPPER = _LOWER.upper()


@dataclass(frozen=True)
class Encoding:
    """What a string may be written in, and what ordinary strings of such characters look like.

    ``same``: chance that two places of an ordinary string hold the same character.  ``turn``: chance that neighbours
    differ in class, which is lower case, upper case, digit or other, and vowel or consonant where all are letters of
    one case (``letters``).  ``in_letters`` and ``in_digits``: share of ordinary letters and digits that the alphabet
    has, at most.  ``chances``: how many are combined (see ``_tested``).  Ordinary words of one case change between vowel and consonant more often than random
    strings do, other ordinary strings change class less often.
    """

    pattern: str
    alphabet: str
    same: float
    turn: float
    letters: bool = False
    in_letters: float = 1.0
    in_digits: float = 1.0

    @property
    def chances(self) -> int:
        return 2 + (self.letters or self.in_letters * self.in_digits < 1)


#: Narrowest first; the last takes what fits no other.
ENCODINGS = [
    Encoding("^[0-9a-f]+$", _DIGITS + "abcdef", 0.075, 1 / 6, in_letters=A_TO_F),
    Encoding("^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.075, 1 / 6, in_letters=A_TO_F),
    Encoding("^[a-z]+$", _LOWER, 0.065, 0.5, True),
    Encoding("^[A-Z]+$", _UPPER, 0.065, 0.5, True),
    Encoding("^[A-Z2-7]+$", _UPPER + "234567", 0.05, 1 / 6, in_digits=0.6),
    Encoding("^[a-z0-9]+$", _LOWER + _DIGITS, 0.05, 1 / 6),
    Encoding("^[A-Z0-9]+$", _UPPER + _DIGITS, 0.05, 1 / 6),
    Encoding("^[A-Za-z0-9]+$", _LOWER + _DIGITS + _UPPER, 0.04, 1 / 3),
    Encoding("^[A-Za-z0-9+/]+$", _LOWER + _DIGITS + "+/" + _UPPER, 0.04, 1 / 3),
    Encoding("", _LOWER + _DIGITS + "+/-_" + _UPPER, 0.04, 1 / 3),
]


def placed(text: Column, pattern: str, keep=None) -> Column:
    """Array of ``start, stop, hit`` (code points) of all matches, leftmost first; ``keep(hit)`` drops some afterwards.

    What lies between matches comes from ``split`` with the same pattern, so its lengths give the positions.
    """
    kind = "array<struct<start:int,stop:int,hit:string>>"
    none = F.array().cast(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["1"])
        stop = start + F.length(x["0"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["0"].alias("hit")))
        kept = one if keep is None else F.when(keep(x["0"]), one).otherwise(none)
        return F.struct(F.concat(state["spans"], kept.cast(kind)).alias("spans"), stop.alias("at"))

    first = F.struct(none.alias("spans"), F.lit(0).alias("at"))
    named = F.transform(pairs, lambda x: F.struct(x["hit"].alias("0"), x["gap"].alias("1")))
    found = F.aggregate(named, first, add)["spans"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(
        found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))
    )


def base_spans(text: Column) -> Column:
    """``start, kind, stop`` of the known shapes, by start and then kind."""
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 12
    return F.sort_array(
        F.concat(
            _spans(placed(text, ASSIGN, long_value), 0),
            _spans(placed(text, ACCESS), 1),
            _spans(placed(text, HEX), 2),
        )
    )


def _tail(z: Column) -> Column:
    """Chance of a normal value under ``z``, within 0.0002 of the exact one and monotone."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _log_tail(z: Column) -> Column:
    """Logarithm of ``_tail``, without underflow."""
    y = -(1.5976 * z + 0.07056 * z * z * z)
    return -F.when(y > 30, y).otherwise(F.log1p(F.exp(F.least(y, F.lit(30.0)))))


def _inferred(run: Column, value) -> Column:
    """``value(number, encoding)`` of the first encoding that the string fits."""
    *narrow, last = enumerate(ENCODINGS)
    out = value(*last)
    for i, encoding in reversed(narrow):
        out = F.when(run.rlike(encoding.pattern), value(i, encoding)).otherwise(out)
    return out


def _turns(run: Column, encoding: Column) -> Column:
    """Places where the class of characters changes."""
    by_class = F.translate(run, _LOWER + _UPPER + _DIGITS + "+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
    by_sound = F.translate(F.lower(run), _LOWER, "a" * 5 + "b" * 21)
    classes = F.when(encoding["letters"], by_sound).otherwise(by_class)
    return (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1).cast("double")


def _alphabet_fit(run: Column, encoding: Column) -> Column:
    """Logarithm of the chance that an ordinary string's letters and digits all lie in the encoding's alphabet."""
    letters = F.length(F.regexp_replace(run, "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(run, "[^0-9]", ""))
    return letters * F.log(encoding["in_letters"]) + digits * F.log(encoding["in_digits"])


def _tested(run: Column) -> Column:
    """The battery on a run of letters: ``encoding`` (its number), ``random``, ``level``.

    Three statistics are taken over the inferred encoding's alphabet: chi-squared of the character counts, runs, and
    serial correlation of neighbours.  ``random``: none of them turns the run away as a uniform string.

    ``level``: decimal logarithm, in ``BINS`` steps, of one over the weighted chance that an ordinary string looks so
    random.  Chances are combined by Fisher's method: a chi-squared as low (as few equal pairs), class changes as many
    (in words of one case, as few), and, where they apply, characters all in a narrower alphabet, and a serial
    correlation as high (words of one case).  Shorter strings weigh less, in proportion to ``FULL_WEIGHT``.  Nothing depends on other strings.
    """
    kind = _inferred(
        run,
        lambda i, e: F.struct(
            F.lit(i).alias("number"),
            F.lit(e.alphabet).alias("alphabet"),
            F.lit(float(len(e.alphabet))).alias("k"),
            F.lit(e.same).alias("same"),
            F.lit(e.turn).alias("turn"),
            F.lit(e.letters).alias("letters"),
            F.lit(e.in_letters).alias("in_letters"),
            F.lit(e.in_digits).alias("in_digits"),
            F.lit(e.chances).alias("chances"),
        ),
    )

    def measure(x: Column) -> Column:
        letters, kind = x["letters"], x["kind"]
        codes = F.transform(letters, lambda c: F.instr(kind["alphabet"], c).cast("double"))
        n = F.size(letters).cast("double")
        squares = F.aggregate(
            F.array_distinct(letters),
            F.lit(0.0),
            lambda s, c: s + F.pow(F.size(F.filter(letters, lambda d: d == c)).cast("double"), F.lit(2.0)),
        )
        mean = F.aggregate(codes, F.lit(0.0), lambda s, v: s + v) / n
        return bound(
            F.struct(codes.alias("codes"), n.alias("n"), squares.alias("squares"), mean.alias("mean"), kind.alias("kind")),
            tests,
        )

    def tests(x: Column) -> Column:
        codes, n, squares, mean, kind = x["codes"], x["n"], x["squares"], x["mean"], x["kind"]
        k = kind["k"]
        chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = F.size(F.filter(codes, lambda v: v > k / 2)).cast("double")
        crossings = F.size(
            F.filter(codes, lambda v, i: (i > 0) & ((v > k / 2) != (F.get(codes, i - 1) > k / 2)))
        ).cast("double")
        wanted = 2 * high * (n - high) / n + 1
        runs = (crossings + 1 - wanted) / F.sqrt(F.greatest((wanted - 1) * (wanted - 2) / (n - 1), F.lit(0.25)))
        power = F.aggregate(codes, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        products = F.aggregate(
            F.sequence(F.lit(1), F.size(codes) - 1),
            F.lit(0.0),
            lambda s, i: s + (F.get(codes, i) - mean) * (F.get(codes, i - 1) - mean),
        )
        serial = products / F.greatest(power, F.lit(1e-9)) + 1 / n
        scores = F.struct(n.alias("n"), squares.alias("squares"), chi.alias("chi"), runs.alias("runs"), serial.alias("serial"))
        return bound(F.struct(scores.alias("of"), kind.alias("kind")), decide)

    def decide(x: Column) -> Column:
        of, kind = x["of"], x["kind"]
        n, root = of["n"], F.sqrt(of["n"])
        least = F.least(
            _tail(-of["chi"]), 2 * _tail(-F.abs(of["runs"])), 2 * _tail(-F.abs(of["serial"] * root))
        )
        pairs, same, turn = n * (n - 1) / 2, kind["same"], kind["turn"]
        spread = F.sqrt(pairs * same * (1 - same) + n * (n - 1) * (n - 2) * UNEVEN * same * same)
        equal = ((of["squares"] - n) / 2 - pairs * same) / spread
        turned = (_turns(run, kind) - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
        logs = (
            _alphabet_fit(run, kind)
            + _log_tail(equal)
            + F.when(kind["letters"], _log_tail(turned)).otherwise(_log_tail(-turned))
            + F.when(kind["letters"], _log_tail((ORDINARY_SERIAL - of["serial"]) * root)).otherwise(F.lit(0.0))
        )
        return bound(
            -logs,
            lambda total: F.struct(
                kind["number"].alias("encoding"),
                (3 * least >= TURNED_AWAY).alias("random"),
                _level(total, kind["chances"], n).alias("level"),
            ),
        )

    def _level(total: Column, chances: Column, n: Column) -> Column:
        fisher = F.log(1 + total + F.when(chances == 3, total * total / 2).otherwise(F.lit(0.0))) - total
        weight = F.log(F.least(n / FULL_WEIGHT, F.lit(1.0)))
        level = F.floor((weight - fisher) / math.log(10) * BINS)
        return F.least(F.greatest(level, F.lit(0)), F.lit(100 * BINS)).cast("int")

    return bound(F.struct(F.split(run, "").alias("letters"), kind.alias("kind")), measure)


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_runs``: the long runs of letters outside base spans, tested."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    based = docs.withColumn("_base", base_spans(text)).withColumn("_found", placed(text, RUN))
    free = F.filter(
        "_found",
        lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])),
    )
    return based.withColumn(
        "_runs",
        F.transform(
            free, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), _tested(x["hit"]).alias("test"))
        ),
    ).drop("_found")


class Levels:
    """For each encoding, the least level at which a run is reported: its false-discovery control.

    Among all runs of an encoding, the chances are cut so that at most ``FALSE_SHARE`` of the reported are expected to be
    ordinary (Benjamini and Hochberg; weights are at most 1, which keeps the bound).  Runs of one encoding don't move
    the cut of another, and more random runs only make it looser.  What is collected is a row for each bin.
    """

    def __init__(self, runs: DataFrame) -> None:
        total: dict[int, int] = {}
        counts: dict[int, dict[int, int]] = {}
        for r in runs.select("test.*").groupBy("encoding", "random", "level").count().collect():
            total[r["encoding"]] = total.get(r["encoding"], 0) + r["count"]
            if r["random"]:
                counts.setdefault(r["encoding"], {})[r["level"]] = r["count"]
        self.lowest: dict[int, int] = {}
        for encoding, own in counts.items():
            reached = 0
            for level in range(max(own), -1, -1):
                reached += own.get(level, 0)
                if 10 ** (-level / BINS) * total[encoding] <= FALSE_SHARE * reached:
                    self.lowest[encoding] = level

    def reported(self, run: Column) -> Column:
        high = F.lit(False)
        for encoding, level in sorted(self.lowest.items()):
            high |= (run["test"]["encoding"] == encoding) & (run["test"]["level"] >= level)
        return run["test"]["random"] & high


def _all_spans(levels: Levels) -> Column:
    added = F.transform(
        F.filter("_runs", levels.reported),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["stop"].alias("stop")),
    )
    return F.sort_array(F.concat("_base", added))


def secret_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, ``base`` and ``spans``: arrays of ``start, kind, stop`` in code points.

    ``kind`` is the index in ``KINDS``; ``base`` has the known shapes, ``spans`` also the random strings.  One scan of
    the texts writes what was found, without the texts unless kept; the levels (see ``Levels``) and the result come from that table.  A null or empty text has no spans, repeated rows have theirs each, and an
    empty table gives an empty one.
    """
    table = Tables(docs.sparkSession, "secrets").write(
        _scanned(docs.select(*(c for c in keep if c != "text"), "text")).select(*keep, "_base", "_runs")
    )
    levels = Levels(table.select(F.explode("_runs").alias("r")).select("r.*"))
    return table.select(*keep, F.col("_base").alias("base"), _all_spans(levels).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``secret_spans`` replaced by ``mark``; spans that overlap are replaced as one.

    Texts are scanned twice, for the levels and for the result, so that they are not stored.  A null text stays null;
    ``n_chars``, if there, is counted anew; other columns stay, whatever their names.
    """
    packed, back = set_apart(docs, ("text", "n_chars"))
    return back(_redacted(packed, mark))


def _redacted(docs: DataFrame, mark: str) -> DataFrame:
    runs = Tables(docs.sparkSession, "secrets").write(
        _scanned(docs.select("text")).select(F.explode("_runs").alias("r")).select("r.*")
    )
    text = F.col("text").cast("string")

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        apart = (x["start"] >= state["at"]) | (state["at"] == 0)
        return F.struct(
            F.when(apart, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
            F.greatest(x["stop"], state["at"]).alias("at"),
        )

    spans = _scanned(docs).withColumn("_spans", _all_spans(Levels(runs)))
    done = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    clean = F.when(
        F.size("_spans") > 0, bound(done, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    ).otherwise(text)
    out = spans.withColumn("text", clean)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)
