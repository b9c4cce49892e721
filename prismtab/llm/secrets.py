"""Secret scans: known shapes, and a battery of randomness tests, in DataFrame operations only.

Tokens (runs of Base64 and Base64url letters) are tested one by one. The least alphabet that holds a
token's letters is its inferred encoding, and three tests are made in that alphabet: chi-squared of
the letters' counts, the number of runs, and the serial correlation of neighbours. Runs are of letters of
one kind (small, capital, digit, sign), or, in an alphabet of one kind, above and below its middle.
The tests are read twice. Against a uniformly random string, joined by Fisher's method, they must not reject.
And against written text and made-up numbers, whose statistics per encoding stand in ENCODINGS,
the same three are joined to the p-value of "not random". Among all tokens of the corpus,
step-up control of the false discovery rate, apart for each class of length and each sort of
alphabet, says from which p-value on a token counts as found.

The corpus-wide step needs counts of p-values in classes of 0.05 powers of ten, so the driver sees
one threshold for each class of length and sort and no token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismtab.llm.common import cut, table

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: Classes of length begin at these.
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
#: Share of false discoveries in a class of length, and the p-value under which a token isn't random.
RATE, NOT_RANDOM = 0.01, 0.005
#: Classes of p-values for each power of ten, and the last class.
PER_TEN, LAST = 20, 800
#: Sorts of alphabets: of numbers, of letters of one case, of more kinds.
NUMBERS, LETTERS, MIXED = range(3)
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from small to large: name, letters, sort; and of text, names in programs or made-up numbers in it: serial correlation, chance that neighbours belong to two runs.
ENCODINGS = (
    ("decimal", _DIGITS, NUMBERS, 0.5, 0.25),
    ("hex", _DIGITS + "abcdef", NUMBERS, 0.5, 0.25),
    ("HEX", _DIGITS + "ABCDEF", NUMBERS, 0.5, 0.25),
    ("lower", _LOWER, LETTERS, 0.0, 0.5),
    ("UPPER", _UPPER, LETTERS, 0.0, 0.5),
    ("base32", _UPPER + "234567", MIXED, 0.1, 0.08),
    ("lower36", _DIGITS + _LOWER, MIXED, 0.2, 0.12),
    ("UPPER36", _DIGITS + _UPPER, MIXED, 0.2, 0.12),
    ("letters", _UPPER + _LOWER, MIXED, 0.6, 0.3),
    ("base62", _DIGITS + _UPPER + _LOWER, MIXED, 0.8, 0.25),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", MIXED, 0.1, 0.2),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", MIXED, 0.1, 0.2),
    ("any", _UPPER + _LOWER + _DIGITS + "+/-_", MIXED, 0.1, 0.2),
)
#: Per sort, of text or a made-up number: the chance that two letters are equal, and that three are.
SAME2, SAME3 = (0.2, 0.068, 0.068), (0.06, 0.0066, 0.0066)
#: Items that one inner step of a fold gathers.
CHUNK = 64


def _let(x: Column, f) -> Column:
    """f of x, with x worked out once."""
    return F.transform(x, f)


def _once(x: Column, f) -> Column:
    return F.transform(F.array(x), f)[0]


def _fold(items: Column, kind: str, step) -> Column:
    """The outs of items in turn, in an array of this kind: step gives struct(at, out) for the place so far and an item.

    Arrays can only be made longer by copying, so outs are gathered in chunks: time grows with the items and not with their square.
    """
    none = F.array().cast(f"array<{kind}>")
    chunks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))).otherwise(F.array())
    inner = lambda at, chunk: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), lambda a, x: _once(step(a["at"], x), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))))
    outer = lambda a, chunk: _once(inner(a["at"], chunk), lambda r: F.struct(r["at"].alias("at"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))
    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("outs")), outer, lambda a: F.flatten(a["outs"]))


def found(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, match), in code points, end exclusive."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def step(at: Column, x: Column) -> Column:
        end = at + x["gap"] + x["n"]
        return F.struct(end.alias("at"), F.struct((at + x["gap"]).alias("start"), end.alias("end"), x["m"].alias("match")).alias("out"))

    return _fold(pairs, "struct<start:int,end:int,match:string>", step)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to about 1e-7 relative to its size (erfc by a rational exponential)."""
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

    def upper(x: Column) -> Column:
        def at(t: Column) -> Column:
            poly = F.lit(terms[-1])
            for c in terms[-2::-1]:
                poly = F.lit(c) + t * poly
            return 0.5 * t * F.exp(-x * x + poly)

        return _once(1.0 / (1.0 + 0.5 * x), at)

    # Each value that is used more than once has a name of its own, or the expression would double with each use.
    return _once(z.cast("double"), lambda z: _once(_once(F.least(F.abs(z), F.lit(35.0)) / F.lit(2**0.5), upper), lambda u: F.when(z >= 0, u).otherwise(1.0 - u)))


def fisher(ps: list[Column]) -> Column:
    """Fisher's method: the p-value of all together."""

    def joined(h: Column) -> Column:
        series, term = F.lit(1.0), F.lit(1.0)
        for j in range(1, len(ps)):
            term = term * h / j
            series = series + term
        return F.least(F.lit(1.0), F.exp(-h) * series)

    return _once(-sum((F.ln(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p))) for p in ps), F.lit(0.0)), joined)


def tested(tokens: Column) -> Column:
    """Each token (start, end, match) with encoding, p_random, p_text, and cls and level: its class, by sort and length, and that of p_text."""
    carried = ("start", "end", "match", "encoding", "sort", "rho", "change", "m", "n")
    of_sort = lambda c, values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), c["sort"] + 1)

    def shape(c: Column) -> Column:
        says = [(F.lit(a).alias("encoding"), F.lit(s).alias("letters"), F.lit(k).alias("sort"), F.lit(r).alias("rho"), F.lit(x).alias("change")) for a, s, k, r, x in ENCODINGS]
        out = F.struct(*says[-1])
        for (_, s, *_), x in zip(ENCODINGS[-2::-1], says[-2::-1], strict=True):
            out = F.when(F.length(F.translate(c["match"], s, "")) == 0, F.struct(*x)).otherwise(out)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), out.alias("e"))

    def symbols(c: Column) -> Column:
        i = F.transform(F.split(c["match"], ""), lambda x: F.instr(c["e"]["letters"], x))
        kind = F.translate(F.translate(F.translate(c["match"], _LOWER, "a" * 26), _UPPER, "A" * 26), _DIGITS + "+/_-", "0" * 10 + "++++")
        return F.struct(*[c[x].alias(x) for x in ("start", "end", "match")], *[c["e"][x].alias(x) for x in ("encoding", "sort", "rho", "change")], F.length(c["e"]["letters"]).cast("double").alias("m"), F.length(c["match"]).cast("double").alias("n"), F.filter(i, lambda x: x > 0).alias("i"), F.filter(F.split(kind, ""), lambda x: x != "").alias("kinds"))

    def counted(c: Column) -> Column:
        i, m, n = c["i"], c["m"], c["n"]
        squares = F.aggregate(F.transform(F.array_distinct(i), lambda v: F.size(F.filter(i, lambda x: x == v))), F.lit(0.0), lambda a, k: a + k * k)
        pairs = F.zip_with(F.slice(i, 1, F.size(i) - 1), F.slice(i, 2, F.size(i) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = (m + 1) / 2
        high = F.size(F.filter(i, lambda x: x > middle)).cast("double")
        halves = F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle)))
        variance = (m * m - 1) / 12
        product = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle))
        changes = F.size(F.filter(F.zip_with(F.slice(c["kinds"], 1, F.size(c["kinds"]) - 1), F.slice(c["kinds"], 2, F.size(c["kinds"]) - 1), lambda a, b: a != b), lambda e: e))
        told = F.when(c["sort"] == MIXED, changes).otherwise(halves).cast("double")
        return F.struct(*[c[x].alias(x) for x in carried], (m / n * squares - n).alias("chi2"), high.alias("high"), (halves + 1).cast("double").alias("runs"), (product / variance / F.sqrt(n - 1)).alias("serial"), told.alias("changes"))

    def judged(c: Column) -> Column:
        m, n, low = c["m"], c["n"], c["n"] - c["high"]
        df = m - 1
        # Against a random string: each test in both directions that matter.
        cube = (F.pow(c["chi2"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        expected = 2 * c["high"] * low / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1)))
        p_runs = F.when((c["high"] == 0) | (low == 0), F.pow(F.lit(0.5), n - 1)).otherwise(2 * normal_tail(F.abs(c["runs"] - expected) / spread))
        p_random = fisher([normal_tail(cube), p_runs, 2 * normal_tail(F.abs(c["serial"]))])
        # Against text: the sum of squared counts has mean n + n (n - 1) SAME2; its variance comes from pairs that share a letter.
        same2, same3, change = of_sort(c, SAME2), of_sort(c, SAME3), c["change"]
        mean = m * (1 + (n - 1) * same2) - n
        spread_text = m / n * F.sqrt(2 * n * (n - 1) * (same2 - same2 * same2) + 4 * n * (n - 1) * (n - 2) * (same3 - same2 * same2))
        p_flat = 1 - normal_tail((c["chi2"] - mean) / spread_text)
        p_changes = normal_tail((c["changes"] - 0.5 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)))
        p_serial = 1 - normal_tail(c["serial"] - c["rho"] * F.sqrt(n - 1))
        p_text = fisher([p_flat, p_changes, p_serial])
        cls = c["sort"] * 100 + sum(((c["n"] >= k).cast("int") for k in LENGTHS[1:]), F.lit(0))
        level = lambda p: F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(F.lit(1e-300), p)) * PER_TEN)).cast("int")
        return _once(p_text, lambda p: F.struct(*[c[x].alias(x) for x in ("start", "end", "match", "encoding")], p_random.alias("p_random"), p.alias("p_text"), cls.alias("cls"), level(p).alias("level")))

    return _let(_let(_let(_let(tokens, shape), symbols), counted), judged)


def thresholds(tokens: DataFrame) -> dict[int, int]:
    """For each class of sort and length the least class of p-values that counts: step-up control at RATE over all tokens (cls, level).

    A class of p-values counts as its greatest p-value. At most 3 * len(LENGTHS) rows come to the driver.
    """
    hist = tokens.groupBy("cls", "level").agg(F.count("*").alias("n"))
    down = Window.partitionBy("cls").orderBy(F.col("level").desc())
    ranked = hist.withColumn("upto", F.sum("n").over(down)).withColumn("total", F.sum("n").over(Window.partitionBy("cls")))
    ok = ranked.filter(F.pow(F.lit(10.0), -F.col("level") / PER_TEN) <= F.col("upto") / F.col("total") * RATE)
    return {r["cls"]: r["level"] for r in ok.groupBy("cls").agg(F.min("level").alias("level")).collect()}


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `__base`, the known shapes' spans in order, and `__tokens`, all tested tokens. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    assign = F.filter(F.when(named, found(t, ASSIGN)).otherwise(none), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)
    access = F.when(t.contains("AKIA"), F.filter(found(t, ACCESS), lambda m: F.length(m["match"]) >= 20)).otherwise(none)
    hexes = F.when(t.rlike(HEX), found(t, HEX)).otherwise(none)
    of = lambda spans, k: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    base = F.array_sort(F.concat(of(assign, 0), of(access, 1), of(hexes, 2)))
    tokens = F.when(t.rlike(TOKEN), tested(found(t, TOKEN)))
    return docs.withColumns({"__base": base, "__tokens": tokens})


def with_spans(cutted: DataFrame) -> DataFrame:
    """A cut table with __base and __tokens: `__spans` instead of the latter, all in order, with what the battery finds clear of the base spans."""
    least = thresholds(cutted.select(F.explode("__tokens").alias("t")).select("t.cls", "t.level"))

    def counts(t: Column) -> Column:
        ok = F.lit(False)
        for cls, at in least.items():
            ok = ok | ((t["cls"] == cls) & (t["level"] >= at))
        clear = ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        return ok & (t["p_random"] >= NOT_RANDOM) & clear

    more = F.transform(F.filter("__tokens", counts), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return cutted.withColumn("__spans", F.array_sort(F.concat("__base", F.coalesce(more, none)))).drop("__tokens")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null text counts as empty and has no spans; repeated rows are each scanned and returned (and each counts in
    the corpus's p-values); doc_id is passed on as it is; other columns are not read; an empty table gives none.
    """
    out = with_spans(cut(scanned(docs.select("doc_id", "text")).drop("text")))
    n = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), n("__base", 0).alias("n_assign"), n("__base", 1).alias("n_access"), n("__base", 2).alias("n_hex"), F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"), n("__spans", 3).alias("n_random"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs (doc_id, text and more) with each stretch of spans in text replaced by mark; other texts stay as they are.

    All other columns are kept, whatever their names. Null text stays null. A text's time grows with its length and its spans.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of its own, so that none can clash
    text = F.col(f"c{names.index('text')}")
    both = with_spans(cut(scanned(inner, f"c{names.index('text')}")))
    chars = F.split(text, "")

    def step(at: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= at, F.concat(F.array_join(F.slice(F.col("__chars"), at + 1, F.greatest(s["start"] - at, F.lit(0))), ""), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(at, s["end"]).alias("at"), piece.alias("out"))

    # The last item is no span but the text's end, and gives what is left.
    spans = F.concat(F.col("__spans"), F.array(F.struct(F.size("__chars").alias("start"), F.lit(-1).alias("kind"), F.size("__chars").alias("end"))))
    joined = F.array_join(_fold(spans, "string", step), "")
    marked = F.substring(joined, F.lit(1), F.length(joined) - len(mark))
    some = both.withColumn("__chars", F.when(F.size("__spans") > 0, chars)).withColumn("__text", F.when(F.size("__spans") == 0, text).otherwise(marked))
    return some.select(*[(F.col("__text") if n == "text" else F.col(c)).alias(n) for n, c in zip(names, inner.columns, strict=True)])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
