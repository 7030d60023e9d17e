"""Personal data: validated numbers, dates and addresses get keyed pseudonyms of their own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.llm.quality import bound
from loglathe.llm.secrets import placed
from loglathe.llm.tables import set_apart
from loglathe.operators.once import evaluate_once

KINDS = ["email", "date", "ip", "ssn", "phone", "card"]
PATTERNS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?!(?!T(?![A-Za-z]))[0-9A-Za-z/-])",
    r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    # a whole run of groups of digits: which of its groups are a card's is decided afterwards
    r"(?<![0-9A-Za-z.-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+",
]
#: Digits of a card number, and how cards are usually written.
CARD_DIGITS = (13, 19)
USUAL_CARD = r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: Rounds of the Feistel networks.
ROUNDS = 6
#: Days from 1900-01-01 on that dates are permuted among, to 2099-12-31, as a product of two numbers.
DAYS = (17, 4297)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _stream(key: str, kind: str, turn: int, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), other), 256)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 31) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _moved(half: Column, other: Column, key: str, kind: str, turn: int) -> Column:
    """``half`` with every digit and letter moved on in its own alphabet, by amounts that ``other`` gives."""

    def one(stream: Column) -> Column:
        def step(c: Column, i: Column) -> Column:
            by = _byte(stream, i)
            small = F.substring(F.lit(_LETTERS), (F.instr(F.lit(_LETTERS), c) - 1 + by) % 26 + 1, F.lit(1))
            large = F.substring(F.lit(_LETTERS.upper()), (F.instr(F.lit(_LETTERS.upper()), c) - 1 + by) % 26 + 1, F.lit(1))
            return (
                F.when(c.rlike("^[0-9]$"), ((c.cast("int") + by) % 10).cast("string"))
                .when(c.rlike("^[a-z]$"), small)
                .when(c.rlike("^[A-Z]$"), large)
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), step), "")

    return F.when(F.length(half) == 0, half).otherwise(bound(_stream(key, kind, turn, other), one))


def permuted_string(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one length and make-up: a Feistel network on the two halves."""
    cut = (F.length(value) / 2).cast("int")
    state = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    for turn in range(ROUNDS):

        def step(s: Column) -> Column:
            return F.struct(s["b"].alias("a"), _moved(s["a"], s["b"], key, kind, turn).alias("b"))

        state = bound(state, step)
    return bound(state, lambda s: F.concat(s["a"], s["b"]))


def permuted_number(value: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of ``0 .. sizes[0] * sizes[1] - 1``: a Feistel network that adds in each of the two places."""
    state = F.struct((value / sizes[1]).cast("int").alias("a"), (value % sizes[1]).cast("int").alias("b"))
    for turn in range(ROUNDS):

        def step(s: Column) -> Column:
            mine, other = ("a", "b") if turn % 2 else ("b", "a")
            amount = F.conv(F.substring(_stream(key, kind, turn, s[other].cast("string")), 1, 12), 16, 10).cast("long")
            moved = ((s[mine] + amount) % sizes[turn % 2 == 0]).cast("int")
            both = {mine: moved, other: s[other]}
            return F.struct(both["a"].alias("a"), both["b"].alias("b"))

        state = bound(state, step)
    return bound(state, lambda s: s["a"].cast("long") * sizes[1] + s["b"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""
    first = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), first, step)["out"]


def _luhn(digits: Column) -> Column:
    """Sum of the digits of a card number, every second one from the right but one doubled and folded."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )


def _day(hit: Column) -> Column:
    return F.coalesce(
        F.try_to_date(hit, "yyyy-MM-dd"), F.try_to_date(hit, "MM/dd/yyyy"), F.try_to_date(hit, "dd.MM.yyyy")
    )


def _day_number(hit: Column) -> Column:
    number = F.datediff(_day(hit), F.to_date(F.lit("1900-01-01")))
    return F.when((number >= 0) & (number < DAYS[0] * DAYS[1]), number)


def _valid(hit: Column, kind: int) -> Column:
    digits = _digits(hit)
    return [
        F.lit(True),
        _day_number(hit).isNotNull(),
        F.forall(F.split(hit, r"\."), lambda x: x.cast("int") <= 255),
        ~hit.rlike("^(000|666|9)") & ~hit.rlike("^...-00") & ~hit.rlike("-0000$"),
        F.lit(True),
        _luhn(digits) % 10 == 0,
    ][kind]


def _pseudonym(hit: Column, kind: int, key: str) -> Column:
    name = KINDS[kind]
    if name == "email":
        # the domain stays, so that the address stays one
        user, rest = F.substring_index(hit, "@", 1), F.concat(F.lit("@"), F.substring_index(hit, "@", -1))
        return F.concat(permuted_string(F.lower(user), key, name), rest)
    if name == "date":
        day = F.date_add(F.to_date(F.lit("1900-01-01")), permuted_number(_day_number(hit), DAYS, key, name).cast("int"))
        return (
            F.when(hit.contains("-"), F.date_format(day, "yyyy-MM-dd"))
            .when(hit.contains("/"), F.date_format(day, "MM/dd/yyyy"))
            .otherwise(F.date_format(day, "dd.MM.yyyy"))
        )
    if name == "ip":
        parts = F.split(hit, r"\.")
        low = parts[2].cast("int") * 256 + parts[3].cast("int")
        high = parts[0].cast("int") * 256 + parts[1].cast("int")
        return bound(
            permuted_number(high.cast("long") * 65536 + low, (65536, 65536), key, name),
            lambda x: F.concat_ws(
                ".", *((F.floor(x / 2**s) % 256).cast("string") for s in (24, 16, 8, 0))
            ),
        )
    if name == "ssn":
        # area and group and serial numbers that are valid: 898 * 99 * 9999, without area 666
        area = hit.substr(1, 3).cast("int")
        number = (
            ((area - 1 - (area > 666).cast("int")) * 99 + hit.substr(5, 2).cast("int") - 1).cast("long") * 9999
            + hit.substr(8, 4).cast("int")
            - 1
        )

        def shaped(x: Column) -> Column:
            a = F.floor(x / (99 * 9999)).cast("int") + 1
            return F.concat_ws(
                "-",
                F.lpad((a + (a >= 666).cast("int")).cast("string"), 3, "0"),
                F.lpad((F.floor(x / 9999) % 99 + 1).cast("string"), 2, "0"),
                F.lpad((x % 9999 + 1).cast("string"), 4, "0"),
            )

        return bound(permuted_number(number, (898 * 99, 9999), key, name).cast("long"), shaped)
    digits = _digits(hit)
    if name == "phone":  # the last nine digits; a country code and the first digit of the area stay
        kept = F.length(digits) - 9
        return _refilled(
            hit,
            F.concat(F.substring(digits, F.lit(1), kept), permuted_string(F.substring(digits, kept + 1, F.lit(9)), key, name)),
        )
    body = F.concat(
        F.substring(digits, 1, 1), permuted_string(F.substring(digits, F.lit(2), F.length(digits) - 2), key, name)
    )
    whole = bound(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _refilled(hit, whole)


_HITS = "array<struct<start:int,stop:int,hit:string,kind:int>>"


def _found(text: Column, kind: int) -> Column:
    """``start, stop, hit, kind`` of the valid ones of a kind other than cards."""
    return F.transform(
        placed(text, PATTERNS[kind], lambda hit: _valid(hit, kind)),
        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["hit"].alias("hit"), F.lit(kind).alias("kind")),
    ).cast(_HITS)


def _cards(text: Column) -> Column:
    """All readings as a card with a right check digit: neighbouring whole groups of a run, 13 to 19 digits together."""
    kind = KINDS.index("card")

    def groups(run: Column) -> Column:
        return bound(
            F.split(run["hit"], ""),
            lambda chars: F.struct(
                chars.alias("chars"),
                F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: _is_digit(F.get(chars, i)) & ~_is_digit(F.get(chars, i - 1))).alias("starts"),
                F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: _is_digit(F.get(chars, i - 1)) & ~_is_digit(F.get(chars, i))).alias("stops"),
            ),
        )

    def readings(run: Column, g: Column) -> Column:
        def ending(i: Column, j: Column) -> Column:
            # one character stands between two groups
            return F.get(g["stops"], j) - F.get(g["starts"], i) - (j - i)

        def of(i: Column) -> Column:
            last = F.least(i + CARD_DIGITS[1] - 1, F.size(g["starts"]) - 1)
            fitting = F.filter(F.sequence(i, last), lambda j: ending(i, j).between(*CARD_DIGITS))
            return F.transform(
                fitting,
                lambda j: F.struct(
                    (run["start"] + F.get(g["starts"], i)).alias("start"),
                    (run["start"] + F.get(g["stops"], j)).alias("stop"),
                    F.array_join(F.slice(g["chars"], F.get(g["starts"], i) + 1, F.get(g["stops"], j) - F.get(g["starts"], i)), "").alias("hit"),
                    F.lit(kind).alias("kind"),
                ),
            )

        every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g["starts"]) - 1), of))
        return F.filter(every, lambda x: _valid(x["hit"], kind))

    runs = placed(text, PATTERNS[kind])
    return F.flatten(F.transform(runs, lambda run: bound(groups(run), lambda g: readings(run, g)))).cast(_HITS)


def _is_digit(c: Column) -> Column:
    return F.coalesce(c.between("0", "9"), F.lit(False))


def _apart(hits: Column) -> Column:
    """Of hits that overlap the leftmost, and of those the longest."""
    none = F.array().cast(_HITS)

    def add(s: Column, x: Column) -> Column:
        taken = F.struct(F.concat(s["hits"], F.array(F.struct(x["start"].alias("start"), (-x["less"]).alias("stop"), x["hit"].alias("hit"), x["kind"].alias("kind"))).cast(_HITS)).alias("hits"), (-x["less"]).alias("at"))
        return F.when(x["start"] >= s["at"], taken).otherwise(s)

    ordered = F.sort_array(
        F.transform(hits, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("less"), x["hit"].alias("hit"), x["kind"].alias("kind")))
    )
    return F.when(F.size(hits) < 2, hits).otherwise(F.aggregate(ordered, F.struct(none.alias("hits"), F.lit(0).alias("at")), add)["hits"])


def _with_found(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_found``: the valid ones of all kinds, by start, none overlapping.

    Each kind is looked for on its own.  Where valid ones overlap, a kind further up goes first: addresses, dates, IPs
    and social security numbers, cards as they are usually written, telephone numbers, other readings as a card.
    """
    text, none = F.col("text").cast("string"), F.array().cast(_HITS)
    own = {f"_{name}": _found(text, k) for k, name in enumerate(KINDS) if name != "card"} | {"_card": _cards(text)}
    gated = {name: F.when(text.rlike("[0-9@]"), hits).otherwise(none) for name, hits in own.items()}
    usual = F.filter("_card", lambda x: x["hit"].rlike(USUAL_CARD))
    other = F.filter("_card", lambda x: ~x["hit"].rlike(USUAL_CARD))
    out = evaluate_once(docs, gated)
    for layer in (F.col("_date"), F.col("_ip"), F.col("_ssn"), usual, F.col("_phone"), other):
        kept = F.col("_found") if "_found" in out.columns else F.col("_email")
        free = F.filter(layer, lambda x: ~F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"])))
        out = evaluate_once(out, {"_found": F.when(F.size(layer) == 0, kept).otherwise(F.concat(kept, bound(free, _apart)))})
    return out.withColumn("_found", F.sort_array("_found")).drop(*own)


def _replaced(hit: Column, kind: Column, key: str) -> Column:
    """What takes the hit's place."""
    out = hit
    for k in range(len(KINDS)):
        out = F.when(kind == k, _pseudonym(hit, k, key)).otherwise(out)
    return out


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` pseudonymized and ``n_<kind>`` for each of ``KINDS``: how many were replaced.

    Found, each kind on its own: e-mail addresses, dates of the calendar (ISO, also before a time, month/day/year,
    day.month.year), IPv4 addresses, social security numbers, telephone numbers, card numbers with a right check digit,
    also between other groups of digits.  Of valid ones that overlap one is taken.  Each is permuted within its
    format by a Feistel network under ``key``: equal values have equal pseudonyms in all documents, different ones
    different ones, dates stay dates, check digits stay right.  Of an e-mail address the user part is permuted, in lower
    case.  What only looks like one (a wrong check digit, a 31st of February) stays.

    Expressions only, one pass.  A null text stays null with counts of 0; repeated rows, null ids and other columns
    stay; columns that are named like a count are replaced; ``n_chars``, if there, is counted anew.
    """
    counts = [f"n_{name}" for name in KINDS]
    packed, back = set_apart(docs.drop(*counts), ("text", "n_chars"))
    return back(_pseudonymized(packed, key), *counts)


def _pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.concat(s["out"], gap, x["new"]).alias("out"), x["stop"].alias("at"))

    marked = _with_found(docs).withColumn(
        "_new",
        F.transform(
            F.coalesce("_found", F.array().cast(_HITS)),
            lambda x: F.struct(
                x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), _replaced(x["hit"], x["kind"], key).alias("new")
            ),
        ),
    )
    clean = F.when(
        F.size("_new") > 0,
        bound(
            F.aggregate("_new", first, step), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
        ),
    ).otherwise(text)
    counts = {
        f"n_{name}": F.size(F.filter("_new", lambda x: x["kind"] == k)).cast("long")
        for k, name in enumerate(KINDS)
    }
    out = marked.withColumns(counts).withColumn("text", clean).drop("_found", "_new")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
