"""The randomness tests of the secret scan against a restatement in plain Python, and what moves their cut."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict

from loglathe.llm import secrets

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")


def _normal(z):
    return 1 / (1 + math.exp(min(-(1.5976 * z + 0.07056 * z**3), 700.0)))


def _class(c, letters):
    if letters:
        return c.lower() in "aeiou"
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"


def battery(run):
    """Number of the encoding, whether no test turns the run away, logarithm of the weighted chance."""
    number, e = next((i, e) for i, e in enumerate(secrets.ENCODINGS) if re.search(e.pattern, run))
    k, n = len(e.alphabet), len(run)
    codes = [e.alphabet.index(c) + 1 for c in run]
    squares = sum(v * v for v in Counter(run).values())
    chi = (k * squares / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [v > k / 2 for v in codes]
    wanted = 2 * sum(high) * (n - sum(high)) / n + 1
    crossings = sum(a != b for a, b in zip(high, high[1:]))
    runs = (crossings + 1 - wanted) / math.sqrt(max((wanted - 1) * (wanted - 2) / (n - 1), 0.25))
    mean = sum(codes) / n
    power = sum((v - mean) ** 2 for v in codes)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / max(power, 1e-9) + 1 / n
    least = min(_normal(-chi), 2 * _normal(-abs(runs)), 2 * _normal(-abs(serial) * math.sqrt(n)))
    pairs = n * (n - 1) / 2
    spread = math.sqrt(pairs * e.same * (1 - e.same) + n * (n - 1) * (n - 2) * secrets.UNEVEN * e.same**2)
    chances = [_normal(((squares - n) / 2 - pairs * e.same) / spread)]
    turns = sum(_class(a, e.letters) != _class(b, e.letters) for a, b in zip(run, run[1:]))
    turned = (turns - (n - 1) * e.turn) / math.sqrt((n - 1) * e.turn * (1 - e.turn))
    chances.append(_normal(turned if e.letters else -turned))
    if e.letters:
        chances.append(_normal((secrets.ORDINARY_SERIAL - serial) * math.sqrt(n)))
    elif e.in_letters * e.in_digits < 1:
        chances.append(e.in_letters ** sum(c.isalpha() for c in run) * e.in_digits ** sum(c.isdigit() for c in run))
    total = -sum(math.log(c) for c in chances)
    fisher = math.log(sum(total**j / math.factorial(j) for j in range(len(chances)))) - total
    return number, 3 * least >= secrets.TURNED_AWAY, fisher - math.log(min(n / secrets.FULL_WEIGHT, 1))


def reported(runs):
    """The runs that the false-discovery control lets through, each encoding on its own."""
    tested = [(r, *battery(r)) for r in runs]
    total, out = Counter(t[1] for t in tested), []
    by_encoding = defaultdict(list)
    for run, number, passes, chance in tested:
        level = min(max(math.floor(-chance / math.log(10) * secrets.BINS), 0), 100 * secrets.BINS)
        if passes:
            by_encoding[number].append((level, run))
    for number, own in by_encoding.items():
        cuts = [
            level
            for level, _ in own
            if 10 ** (-level / secrets.BINS) * total[number] <= secrets.FALSE_SHARE * sum(x >= level for x, _ in own)
        ]
        # a bin without runs of its own can't let more through than the next one with some
        out += [run for level, run in own if cuts and level >= min(cuts)]
    return sorted(out)


def _strings(seed, letters, length, count):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(length)) for _ in range(count)]


def _names(seed, count):
    rng = random.Random(seed)
    words = "read line index of table name customer order total value count user session cache http client server".split()
    return ["".join(w.capitalize() if rng.random() < 0.7 else w for w in rng.choices(words, k=5)) for _ in range(count)]


def _words(seed, count):
    rng = random.Random(seed)
    parts = "ver ein ter keit schaft lung un ge sich ten tion aux en ne er heit lich".split()
    return ["".join(rng.choices(parts, k=7)) for _ in range(count)]


def _found(spark, runs):
    table = spark.createDataFrame([(f"key {x} or",) for x in runs], "text string").repartition(4)
    rows = secrets.secret_spans(table, ["text"]).collect()
    return sorted(r["text"][a:b] for r in rows for a, k, b in r["spans"] if k == 3)


def test_equals_brute_force(spark):
    alphabets = [string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.digits + "ABCDEF",
                 string.ascii_lowercase, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/",
                 string.ascii_letters + "-_", string.ascii_uppercase]
    runs = [x for i, a in enumerate(alphabets) for n in (20, 40, 64, 200) for x in _strings(10 * i + n, a, n, 8)]
    runs += _names(1, 100) + _words(2, 150) + ["A" * 16, "aB" * 5000, "a_long_name_of_a_thing", "Zz9" * 6]
    runs = [r for r in runs if RUN.fullmatch(r) and not re.search("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", r)]
    want = reported(runs)
    assert _found(spark, runs) == want and 100 < len(want) < len(runs) - 200


def test_random_words_don_t_silence_keys(spark):
    keys = _strings(5, string.ascii_letters + string.digits, 40, 50)
    ordinary = _names(3, 200) + _words(4, 400)
    for count in (0, 8, 80):
        low = _strings(6, string.ascii_lowercase, 40, count)
        got = _found(spark, keys + ordinary + low)
        assert len(set(got) & set(keys)) >= 45
        assert sum(x not in keys and x not in low for x in got) <= 0.05 * len(got)
    assert len(set(got) & set(low)) >= 20


def test_one_very_long_run_moves_nothing(spark):
    keys = _strings(7, string.ascii_letters + string.digits, 40, 20) + _names(8, 100)
    long = _strings(9, string.ascii_letters + string.digits, 60_000, 1)
    assert set(_found(spark, keys + long)) == set(_found(spark, keys)) | set(long)


def test_no_runs(spark):
    assert _found(spark, []) == [] and _found(spark, ["short"]) == []
