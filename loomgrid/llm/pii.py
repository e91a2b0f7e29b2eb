"""Personal data by gradient-boosted candidates, in DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers; what passes their checks always stays. High-recall
generators propose further, overlapping spans: anything around an at sign, addresses spelled out with "at" and "dot", any run
of digits and separators, long mixed runs of letters and digits (keys and tokens), international account numbers and IPv6
addresses. Each candidate gets yes-or-no features of its format and of the text around it.

Labels are weak and don't come from the base patterns: a candidate is positive if its format check holds (a checksum, a mix of
letters and digits, the shape of an address) and the text before it names such data or assigns it; it is negative if its
format check fails; all others are unlabelled. Boosted trees of depth two are fitted on the counts by feature pattern (at
most 2**features rows, whatever the corpus). Held-out labelled candidates calibrate the lowest score whose precision reaches
`precision`, for each generator, and for all together where a generator has too few; candidates at or above it that
overlap no base span become spans of their own kind, so the trees decide on the unlabelled ones.

The patterns are written so that Java's matcher neither backtracks over long runs nor recurses: runs are possessive, and a
repeated group is one character behind a lookahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import cut, stored
from loomgrid.llm.native import indices, let, spans

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.(?=[{_LABEL}])(?:(?!\.(?![{_LABEL}]))[A-Za-z0-9.-])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap necessary condition of each pattern; texts without it are not searched.
_GUARD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: A part may be zero or led by zeros: the digits after them may be none, as long as there is one at all.
_OCTET = r"(?=[0-9])0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
WIDE = {
    "email": r"(?:\G|(?<![^\s<>()\[\],;]))[^\s<>()\[\],;@]++@[^\s<>()\[\],;@]++",
    "spelled": r"(?i)\b[a-z0-9._%+-]{2,64}+\s?+[\[(]?(?:at|arroba)[\])]?\s?+[a-z0-9-]{2,63}+\s?+[\[(]?(?:dot|punto|punkt|point)[\])]?\s?+[a-z]{2,24}+\b",
    "number": r"(?<![0-9A-Za-z])\+?[0-9](?:(?![ ().-]{3})(?![ ().-]+(?![0-9 ().-]))[0-9 ().-]){5,}+(?![A-Za-z])",
    "token": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]{0,64}[0-9])(?=[0-9_]{0,64}[A-Za-z])[A-Za-z0-9_]{16,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?! (?![A-Z0-9]{2}))[A-Z0-9 ]){11,}+",
    "ipv6": r"(?i)(?<![0-9a-z:])[0-9a-f]{1,4}:(?=[0-9a-f:]{0,34}:)[0-9a-f:]{3,}+(?![0-9a-z])",
}
#: Cheap necessary conditions of the generators.
_WIDE_GUARD = {"email": r"@", "spelled": r"(?i)(?:dot|punto|punkt|point)", "number": r"[0-9][0-9 ().-]{4}", "token": r"[0-9][A-Za-z_]|[A-Za-z_][0-9]", "account": r"[A-Z]{2}[0-9]{2}", "ipv6": r":[0-9a-fA-F]{0,4}:"}
CONTEXT = 24


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""

    def weigh(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(indices(F.length(digits)), F.lit(0), weigh) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(_OCTETS)
    if kind == "card":
        return let(_digits(hit), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _found(text: Column, pattern: str, guard: str) -> Column:
    return F.when(text.rlike(guard), spans(text, pattern)).otherwise(F.array().cast("array<struct<start:int,stop:int,hit:string>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Add base: array of (kind number, start, stop) to documents with text; kinds in order, then places."""
    text = F.col("text")

    def kept(n: int, kind: str) -> Column:
        right = F.filter(_found(text, BASE[kind], _GUARD[kind]), lambda s: _valid(kind, s["hit"]))
        return F.transform(right, lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    per_kind = [kept(n, k) for n, k in enumerate(KINDS)]
    return docs.withColumn("base", F.concat(*per_kind))


def mod97(account: Column) -> Column:
    """True where an account number (its letters and digits) leaves 1 modulo 97 with its first four characters put last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i + 1, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(indices(F.length(turned)), F.lit(0), step) == 1


#: Words that announce personal data or secrets, at the end of the text before a candidate.
_NAMES = r"(?:tel|phone|call|fax|mobil|card|kart|tarjeta|carte|mail|correo|ip|contact|address|ssn|social|tax|passport|iban|account|konto|cuenta|compte|token|key|secret|passw|pwd|auth|bearer|credential|hash|session|cookie)"
N_FEATURES = 14


def _features(hit: Column, before: Column, after: Column) -> list[Column]:
    d = _digits(hit)
    n = F.length(d)
    plain = F.regexp_replace(hit, "[^A-Z0-9]", "")
    return [
        hit.contains("@"), hit.rlike(r"(?i)[a-z0-9]\.[a-z]{2,24}$"), hit.startswith("+"), hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), n.between(8, 15), n.between(13, 19),
        n.between(12, 24) & luhn(F.when(n <= 24, d).otherwise("1")), hit.rlike(r"[()]"), hit.rlike(r"[0-9][ -][0-9]"),
        before.rlike(_NAMES + r"\W{0,4}\w{0,8}\W{0,4}$"), before.rlike(r"[=:]\s?[\"']?$"),
        hit.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), hit.rlike(r"[0-9][^0-9]{0,8}[0-9][^0-9]{0,8}[0-9]"),
        F.length(plain).between(15, 34) & mod97(F.when(F.length(plain) <= 34, plain).otherwise("1")),
    ]


def _sound(source: str, hit: Column) -> Column:
    """The format check of a generator, on whatever text: the half of a label that the span itself gives."""
    d = _digits(hit)
    n = F.length(d)
    plain = F.regexp_replace(hit, "[^A-Z0-9]", "")
    return {
        "email": hit.rlike(r"(?i)^[^@]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}$"),
        "spelled": hit.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|at|ch)$"),
        "number": hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | (n.between(13, 19) & luhn(F.when(n <= 24, d).otherwise("1"))) | (n.between(9, 13) & hit.rlike(r"^\+|^0|^\(")),
        "token": F.length(F.regexp_replace(hit, "[^0-9]", "")).between(4, 1000) & (F.length(hit) >= 20),
        "account": F.length(plain).between(15, 34) & mod97(F.when(F.length(plain) <= 34, plain).otherwise("1")),
        "ipv6": hit.rlike(r"(?i)^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$)[0-9a-f:]*::[0-9a-f:]*$"),
    }[source]


def candidates(docs: DataFrame) -> DataFrame:
    """Add candidates to documents with text and base: array of (source, start, stop, covered, sound, pattern), one for each proposed span."""
    text = F.col("text")

    def proposed(kind: str) -> Column:
        def one(s: Column) -> Column:
            before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(s["start"], F.lit(CONTEXT))))
            flags = _features(s["hit"], before, F.substring(text, s["stop"] + 1, F.lit(1)))
            pattern = sum((F.coalesce(v.cast("int"), F.lit(0)) * (1 << k) for k, v in enumerate(flags)), F.lit(0))
            covered = F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
            return F.struct(F.lit(kind).alias("source"), s["start"].alias("start"), s["stop"].alias("stop"), covered.alias("covered"), _sound(kind, s["hit"]).alias("sound"), pattern.alias("pattern"))

        return F.transform(_found(text, WIDE[kind], _WIDE_GUARD[kind]), one)

    return docs.withColumn("candidates", F.concat(*[proposed(k) for k in WIDE]))


_NAMED, _ASSIGNED = 9, 10  # the features that say what the text before calls a candidate


def _bit(pattern: Column, k: int) -> Column:
    return pattern.bitwiseAND(1 << k) > 0


Tree = tuple[int, int, dict[int, float]]


def score(trees: list[Tree], pattern: Column) -> Column:
    """The raw score of a pattern: the sum of the leaves it falls in."""
    total = F.lit(0.0)
    for i, j, leaves in trees:
        leaf = _bit(pattern, i).cast("int") * 2 + _bit(pattern, j).cast("int")
        for k, step in leaves.items():
            total = total + F.when(leaf == k, step).otherwise(0.0)
    return F.round(total, 6)


def boost(patterns: DataFrame, rounds: int = 6, rate: float = 0.5) -> list[Tree]:
    """Boosted trees of depth two on logistic loss over (pattern, y, n): two features each, and the value of every leaf.

    A round tries every pair of features as one aggregate; Newton steps give the leaves, and one row comes back.
    """
    trees: list[Tree] = []
    pairs = [(i, j) for i in range(N_FEATURES) for j in range(i + 1, N_FEATURES)]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-score(trees, F.col("pattern"))))
        graded = patterns.select("pattern", ((F.col("y") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
        leaf = [F.struct(F.lit(k).alias("pair"), (_bit(F.col("pattern"), i).cast("int") * 2 + _bit(F.col("pattern"), j).cast("int")).alias("leaf")) for k, (i, j) in enumerate(pairs)]
        sums = graded.select("g", "h", F.explode(F.array(*leaf)).alias("l")).groupBy("l.pair", "l.leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        gains = sums.groupBy("pair").agg(F.sum(F.col("g") * F.col("g") / (F.col("h") + 1)).alias("gain"), F.collect_list(F.struct("leaf", (F.col("g") / (F.col("h") + 1)).alias("step"))).alias("steps"))
        best = gains.orderBy(F.desc(F.round("gain", 6)), "pair").first()
        if best is None or best.gain < 1e-6:
            break
        trees.append((*pairs[best.pair], {s.leaf: rate * s.step for s in best.steps}))
    return trees


def thresholds(held: DataFrame, trees: list[Tree], precision: float, enough: int = 20) -> dict[str, float]:
    """For each source the lowest score from which upwards the held-out candidates reach the precision.

    A source with fewer than `enough` labelled ones takes the threshold of all sources together.
    """
    ranked = held.withColumn("score", score(trees, F.col("pattern")))
    ranked = ranked.unionByName(ranked.withColumn("source", F.lit(""))).groupBy("source", "score").agg(F.sum(F.col("y") * F.col("n")).alias("hits"), F.sum("n").alias("all"))
    above = Window.partitionBy("source").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # at most 2**features rows a source
    reached = ranked.withColumn("p", F.sum("hits").over(above) / F.sum("all").over(above)).withColumn("ok", F.col("p") >= precision)
    rows = reached.groupBy("source").agg(F.min(F.when(F.col("ok"), F.col("score"))).alias("least"), F.sum("all").alias("n")).collect()  # a row for each source
    own = {r.source: r.least for r in rows if r.n >= enough or not r.source}
    shared = own.pop("", None)
    return {k: v for k, v in {kind: own.get(kind, shared) for kind in WIDE}.items() if v is not None}


def find(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """Add base and added to every row: arrays of spans in code points.

    A null text has no spans. Repeated rows are each searched. Texts are searched whole. An empty table gives no rows. Other
    columns pass through, except those named base, candidates and added, which are replaced.
    """
    return _decided(candidates(base_spans(docs.drop("base", "candidates", "added").withColumn("text", F.coalesce("text", F.lit(""))))), precision)


def find_spans(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """find() without the texts: they are searched once, and what was found is stored for the trees and for the result."""
    proposed = candidates(base_spans(docs.drop("base", "candidates", "added").withColumn("text", F.coalesce("text", F.lit("")))))
    return _decided(stored(proposed.withColumn("_fold", _fold()).drop("text"), "candidates"), precision, F.col("_fold")).drop("_fold")


def _fold() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(4)) == 0


def _decided(proposed: DataFrame, precision: float, fold: Column | None = None) -> DataFrame:
    fold = _fold() if fold is None else fold
    each = proposed.select(fold.alias("held"), F.explode("candidates").alias("c"))
    told = _bit(F.col("c.pattern"), _NAMED) | _bit(F.col("c.pattern"), _ASSIGNED)
    label = F.when(~F.col("c.sound"), 0.0).when(told, 1.0)
    counts = cut(each.select("held", "c.source", "c.pattern", label.alias("y")).where("y IS NOT NULL").groupBy("held", "source", "pattern", "y").agg(F.count("*").cast("double").alias("n")))
    trees = boost(counts.where("NOT held"))
    least = thresholds(counts.where("held"), trees, precision)

    def chosen(c: Column) -> Column:
        good = F.lit(False)
        for source, from_score in least.items():
            good = good | ((c["source"] == source) & (score(trees, c["pattern"]) >= from_score))
        return ~c["covered"] & c["sound"] & good

    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")

    def apart(found: Column) -> Column:  # of overlapping proposals the first, and of those the longest
        ordered = F.sort_array(F.transform(found, lambda c: F.struct(c["start"].alias("start"), (-c["stop"]).alias("back"), c["source"].alias("source"))))

        def add(acc: Column, x: Column) -> Column:
            more = F.concat(acc["out"], F.array(F.struct(x["source"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("stop"))))
            return F.when(x["start"] >= acc["end"], F.struct((-x["back"]).alias("end"), more.alias("out"))).otherwise(acc)

        return F.aggregate(ordered, F.struct(F.lit(-1).alias("end"), none.alias("out")), add, lambda acc: acc["out"])

    return proposed.withColumn("added", apart(F.filter("candidates", chosen))).drop("candidates")


def redact(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, overlapping spans by the first of them; n_chars follows.

    All other columns stay, those with names that find() uses too.
    """
    own = {c: f"_own_{c}" for c in ("base", "candidates", "added") if c in docs.columns}
    found = find(docs.withColumnsRenamed(own), precision)
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.get(names, s["kind"]).alias("kind")))
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))

    def cover(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), put.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

    spans_ = F.sort_array(F.concat(base, more))
    text = F.aggregate(spans_, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cover, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = found.withColumn("text", F.when(F.size("base") + F.size("added") > 0, text).otherwise(F.col("text"))).drop("base", "added").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))
    more = F.transform(F.sort_array("added"), lambda s: F.concat(F.lit("likely_"), s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = [count(n) for n in range(len(KINDS))]
    total = (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.size("added").cast("long").alias("n_added"), total, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))
