"""Personal data: base patterns plus spans chosen by boosted trees, in DataFrame functions only.

Base kinds are found by pattern and check. High-recall generators propose further spans (long
opaque tokens, digit groups, written-out addresses), which may overlap each other. Each candidate
has a few binary format and context features, so the training table is the candidates' counts by
feature set, label and half of the documents: bounded by the number of feature sets, whatever the
corpus. Trees are boosted on the driver over the counts of one half and become column expressions;
the other half gives each generator the least margin that reaches a wanted precision. Candidates
that overlap a base span are neither learned from nor added.

There are no true labels to learn from, so labels are weak: each generator has three voters (a cue
word before, the syntax around, the layout), and a candidate is positive where two of them agree.

Positions are code points, end exclusive. Null texts are empty and have no spans. Overlapping
base spans of different kinds all stay; ties are in the order of KINDS. Repeated rows each give a
row; an empty table gives none, and with no candidates to learn from nothing is added. Columns of
the table may have any names. Arrays are built in chunks, so that a text of very many matches
takes time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

# Base patterns. Starts inside a run that cannot begin a match are skipped (the
# look-behind; \G keeps the place where the match before ended), and what can match only one way
# does not backtrack, so that very long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ["email", "ip", "card", "phone"]

# Candidate generators and the words that stand before what they look for.
GENERATORS = {
    "secret": r"(?:(?<![A-Za-z0-9_+/=-])|\G)[A-Za-z0-9_+/=-]{16,}+",
    "number": r"(?:(?<![0-9])|\G)[0-9](?:[\x20().-]?[0-9]){6,}+",
    "contact": r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]++",
}
GUARDS = {"secret": r"[A-Za-z0-9_+/=-]{16}", "number": r"[0-9](?:[\x20().-]?[0-9]){6}", "contact": r"[\[(]at[\])]"}
SECRET_WORDS = r"token|secret|passw(?:or)?d|api[_-]?key|key|bearer"
NUMBER_WORDS = r"tel|phone|call|fax|mobile|cell|card|account|acct|iban|ssn|passport"
CONTACT_WORDS = r"mail|contact|write|reach|tel|phone|call|fax"
#: Settings of the fit: trees, their rate, the precision wanted, and the least candidates it is measured on.
TREES = 24
RATE = 0.4
PRECISION = 0.95
LEAST_COUNT = 5
#: Elements that one pass over an array appends to, and code points of a block of text.
CHUNK = 256
BLOCK = 1024
SPAN = "struct<s:int,k:int,e:int>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(rows: Column, start: Column, step, emit, element: str) -> Column:
    """emit(state, x) for each x of an array in order, the state going from x to x by step(state, x).

    Spark copies an array to append to it, so the results are appended in chunks.
    """
    empty = F.array().cast(f"array<{element}>")
    one = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], emit(acc["state"], x)).alias("out"))

    def over(r):
        def part(acc, k):
            made = F.aggregate(F.slice(r, k * CHUNK + 1, CHUNK), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
            return bind(made, lambda m: F.struct(m["state"].alias("state"), F.array_append(acc["out"], m["out"]).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int"))
        done = F.aggregate(chunks, F.struct(start.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out")), part, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(r) > 0, done).otherwise(empty)

    return bind(rows, over)


def found(text: Column, pattern: str, guard: Column) -> Column:
    """Array of struct(s, e, m, c): matches with their places and up to 24 characters before."""
    none = "array<struct<s:int,e:int,m:string,c:string>>"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    measure = lambda p: F.struct(F.char_length(p["b"]).alias("gap"), F.char_length(p["m"]).alias("n"), p["m"].alias("m"), F.right(p["b"], F.lit(24)).alias("c"))
    rows = F.transform(F.filter(zipped, lambda p: p["m"].isNotNull()), measure)
    place = lambda at, x: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["m"].alias("m"), x["c"].alias("c"))
    out = scan(rows, F.lit(0), lambda at, x: at + x["gap"] + x["n"], place, none[6:-1])
    return F.when(guard, out).otherwise(F.array().cast(none))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def base_columns(text: Column) -> dict[str, Column]:
    """kind -> array of the spans that pass."""
    n = lambda m: F.length(digits(m))
    return {
        "email": found(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(found(text, IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(found(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: n(x["m"]).between(14, 19) & F.call_function("luhn_check", digits(x["m"]))),
        "phone": F.filter(found(text, PHONE, F.contains(text, F.lit("+"))), lambda x: n(x["m"]).between(10, 15)),
    }


def _cue(kind: str, x: Column) -> Column:
    """Whether a cue word stands before the candidate, or begins it."""
    if kind == "secret":
        return x["c"].rlike(rf"(?i)(?:{SECRET_WORDS})[\"']?\s*(?:[=:]|is)?\s*[\"']?$") | x["m"].rlike(rf"(?i)^(?:{SECRET_WORDS})=")
    words = NUMBER_WORDS if kind == "number" else CONTACT_WORDS
    return x["c"].rlike(rf"(?i)(?:{words})\W{{0,3}}(?:to|me|us|at|no|number|is)?\W{{0,3}}$")


def _syntax(kind: str, x: Column) -> Column:
    """Whether the candidate is assigned, quoted, numbered or bracketed."""
    if kind == "secret":
        return x["c"].rlike("[=:\"']\\s*$") | x["m"].rlike("^[A-Za-z_-]+=[^=]")
    return x["c"].rlike(r"[+#:(<]\s*$")


def _layout(kind: str, x: Column) -> Column:
    """Whether the candidate itself looks like what the generator is after."""
    m = x["m"]
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (m.rlike("[0-9a-fA-F]{16}") | (m.rlike("[a-z]") & m.rlike("[A-Z]")))
    if kind == "number":
        n = F.length(digits(m))
        card = F.when(n.between(14, 19), F.call_function("luhn_check", digits(m))).otherwise(F.lit(False))
        return card | m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return m.rlike(r"\.[A-Za-z]{2,}\.?$")


def feature_list(kind: str, x: Column) -> list[Column]:
    """Binary format and context features of a candidate."""
    m, c = x["m"], x["c"]
    n = F.length(digits(m))
    return [
        F.lit(kind == "secret"),
        F.lit(kind == "number"),
        F.length(m) >= 24,
        F.length(m) >= 40,
        m.rlike("^[0-9a-fA-F]+$"),
        m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
        m.rlike("[a-z]") & m.rlike("[A-Z]"),
        n.between(10, 15),
        n.between(14, 19),
        m.rlike(r"[\x20().-]"),
        m.rlike(r"\.[A-Za-z]{2,}"),
        m.rlike("=[^=]"),
        c.rlike(r"[+(#]\s*$"),
        c.rlike("[=:\"']\\s*$"),
        _cue(kind, x),
    ]


N_FEATURES = 15


def _bits(kind: str, x: Column) -> Column:
    out = F.lit(0)
    for i, f in enumerate(feature_list(kind, x)):
        out = out + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _weak_label(kind: str, x: Column) -> Column:
    votes = [v(kind, x).cast("int") for v in (_cue, _syntax, _layout)]
    return votes[0] + votes[1] + votes[2] >= 2


def base_spans(text: Column) -> Column:
    """All base spans as struct(s, k, e, bits) by start and kind; k counts KINDS."""
    row = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(0).alias("bits"))
    return F.array_sort(F.concat(*[F.transform(c, row(i)) for i, c in enumerate(base_columns(text).values())]))


def candidates(text: Column, labelled: bool) -> Column:
    """All candidates as struct(s, k, e, bits): k counts on from KINDS, a label is the bit after the features."""

    def row(kind, k):
        def make(x):
            bits = _bits(kind, x)
            if labelled:
                bits = bits + F.when(_weak_label(kind, x), F.lit(1 << N_FEATURES)).otherwise(F.lit(0))
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), bits.alias("bits"))

        return make

    return F.concat(*[F.transform(found(text, p, text.rlike(GUARDS[kind])), row(kind, len(KINDS) + i)) for i, (kind, p) in enumerate(GENERATORS.items())])


def clear(base: Column, rows: Column) -> Column:
    """The spans of rows, sorted, that overlap no base span; all are struct(s, k, e, bits)."""
    is_base = lambda x: x["k"] < len(KINDS)
    element = "struct<s:int,k:int,e:int,bits:int,hit:boolean>"
    mark = lambda x, hit: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["bits"].alias("bits"), hit.alias("hit"))

    def check(rows):
        # a base span before it that ends after its start, or one after it that starts before its end
        ahead = scan(F.array_sort(F.concat(base, rows)), F.lit(0), lambda end, x: F.when(is_base(x), F.greatest(end, x["e"])).otherwise(end), lambda end, x: mark(x, end > x["s"]), element)
        behind = scan(F.reverse(ahead), F.lit(2**31 - 1), lambda first, x: F.when(is_base(x), F.least(first, x["s"])).otherwise(first), lambda first, x: mark(x, x["hit"] | (first < x["e"])), element)
        kept = F.filter(F.reverse(behind), lambda x: ~is_base(x) & ~x["hit"])
        plain = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["bits"].alias("bits")))
        return F.when((F.size(rows) == 0) | (F.size(base) == 0), F.array_sort(rows)).otherwise(plain)

    return bind(rows, check)


def kind_of(bits: int) -> str:
    """The generator of a feature set."""
    return "secret" if bits & 1 else "number" if bits & 2 else "contact"


def boost(counts: list[tuple[int, int, int]], trees: int = TREES, rate: float = RATE) -> tuple[list[tuple], float]:
    """(trees, start) from (features, negatives, positives) counts, by the logistic loss.

    A tree is (i, j, four leaf values) on two binary features, the pair of most gain.
    """
    pos, neg = sum(r[2] for r in counts), sum(r[1] for r in counts)
    if not pos:
        return [], 0.0
    start = math.log((pos + 0.5) / (neg + 0.5))
    margin = {b: start for b, _, _ in counts}
    made: list[tuple] = []
    for _ in range(trees):
        best = None
        slope = [(b, n1 - (n0 + n1) * p, (n0 + n1) * p * (1 - p)) for b, n0, n1 in counts for p in [1 / (1 + math.exp(-max(-30.0, min(30.0, margin[b]))))]]
        for i in range(N_FEATURES):
            for j in range(i, N_FEATURES):
                g, h = [0.0] * 4, [1.0] * 4
                for b, up, curve in slope:
                    leaf = (b >> i & 1) * 2 + (b >> j & 1)
                    g[leaf] += up
                    h[leaf] += curve
                gain = sum(a * a / c for a, c in zip(g, h))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, i, j, tuple(max(-4.0, min(4.0, rate * a / c)) for a, c in zip(g, h)))
        _, i, j, leaves = best
        made.append((i, j, leaves))
        for b in margin:
            margin[b] += leaves[(b >> i & 1) * 2 + (b >> j & 1)]
    return made, start


def margin(bits: int, trees: list[tuple], start: float) -> float:
    return start + sum(leaves[(bits >> i & 1) * 2 + (bits >> j & 1)] for i, j, leaves in trees)


def calibrate(counts: list[tuple[int, int, int]], trees: list[tuple], start: float, precision: float = PRECISION, least: int = LEAST_COUNT) -> dict[str, float]:
    """For each generator the least margin at or above which the smoothed share of positives reaches the precision.

    counts: of rows that the trees were not fitted on. A generator that never reaches it is left out.
    """
    out: dict[str, float] = {}
    if not trees:
        return out
    for kind in GENERATORS:
        by: dict[float, list[int]] = {}
        for b, n0, n1 in counts:
            if kind_of(b) == kind:
                at = by.setdefault(margin(b, trees, start), [0, 0])
                at[0] += n0 + n1
                at[1] += n1
        seen = right = 0
        for m in sorted(by, reverse=True):
            seen, right = seen + by[m][0], right + by[m][1]
            if seen >= least and (right + 0.5) / (seen + 1) >= precision:
                out[kind] = m - 1e-9
    return out


def margin_column(bits: Column, trees: list[tuple], start: float) -> Column:
    """The boosted trees as one expression."""
    out = F.lit(start)
    on = lambda i: bits.bitwiseAND(F.lit(1 << i)) != 0
    for i, j, v in trees:
        out = out + F.when(on(i), F.when(on(j), F.lit(v[3])).otherwise(F.lit(v[2]))).otherwise(F.when(on(j), F.lit(v[1])).otherwise(F.lit(v[0])))
    return out


def fit(docs: DataFrame, text_col: str = "text") -> tuple[list[tuple], float, dict[str, float]]:
    """(trees, start, threshold of each generator) from the candidates of all documents.

    Documents whose hashed text is even are boosted on, the others calibrated on.
    """
    text = F.col("text")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(text.rlike("|".join(GUARDS.values())))
    rows = rows.select(F.pmod(F.xxhash64(text), F.lit(2)).alias("half"), base_spans(text).alias("base"), candidates(text, True).alias("more"))
    rows = rows.select("half", F.explode(clear(F.col("base"), F.col("more"))).alias("r")).groupBy("half", "r.bits").count()
    halves: tuple[dict, dict] = ({}, {})
    for r in rows.collect():
        label, bits = divmod(r["bits"], 1 << N_FEATURES)
        halves[r["half"]].setdefault(bits, [0, 0])[label] += r["count"]
    first, second = ([(b, *n) for b, n in sorted(half.items())] for half in halves)
    trees, start = boost(first)
    return trees, start, calibrate(second, trees, start)


def spans(docs: DataFrame, model: tuple[list[tuple], float, dict[str, float]], text_col: str, names: tuple[str, str]) -> DataFrame:
    """Add the base spans and all spans, under `names`: arrays of struct(s, k, e, bits) by start and kind."""
    trees, start, thresholds = model
    base, every = names
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(base, base_spans(text))
    if not thresholds:
        return out.withColumn(every, F.col(base))

    def chosen(x):
        cut = F.lit(None).cast("double")
        for i, kind in enumerate(GENERATORS):
            if kind in thresholds:
                cut = F.when(x["k"] == len(KINDS) + i, F.lit(thresholds[kind])).otherwise(cut)
        return F.coalesce(margin_column(x["bits"], trees, start) >= cut, F.lit(False))

    added = clear(F.col(base), F.filter(candidates(text, False), chosen))
    return out.withColumn(every, F.array_sort(F.concat(F.col(base), added)))


NAMES = [*KINDS, *GENERATORS]


def joined(rows: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, rows: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by [KIND] of its first."""
    names = F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES])
    element = "struct<at:int,s:int,k:int,first:boolean>"

    def build(blocks):
        def piece(a, b):
            """Code points a to b, found through the block that a is in."""
            first = F.floor(a / BLOCK).cast("int")
            run = F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1)
            return F.when(b > a, F.substring(F.array_join(run, ""), F.pmod(a, F.lit(BLOCK)) + 1, b - a)).otherwise(F.lit(""))

        mark = lambda at, x: F.struct(at.alias("at"), x["s"].alias("s"), x["k"].alias("k"), (x["s"] >= at).alias("first"))
        runs = F.filter(scan(rows, F.lit(0), lambda at, x: F.greatest(at, x["e"]), mark, element), lambda x: x["first"])
        last = F.array_max(F.transform(rows, lambda x: x["e"]))
        return F.concat(F.array_join(F.transform(runs, lambda x: F.concat(piece(x["at"], x["s"]), F.element_at(names, x["k"] + 1))), ""), piece(last, F.char_length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(rows) == 0, text).otherwise(bind(cut, build))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    marked = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, text_col), "text", ("base", "every"))
    count = lambda i: F.size(F.filter(F.col("base"), lambda x: x["k"] == i)).cast("long")
    return marked.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans in their texts replaced; null texts stay null."""
    names = fresh(docs, "base", "every")
    marked = spans(docs, fit(docs, text_col), text_col, names)
    text = F.col(f"`{text_col}`")
    out = marked.withColumn(text_col, F.when(text.isNotNull(), redacted(text, F.col(names[1]))))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.coalesce(F.char_length(text).cast(docs.schema[size_col].dataType), F.col(size_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
