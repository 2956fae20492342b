"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Base rules find emails, IP addresses, card and phone numbers by pattern and check.
   They always stay.
2. High-recall generators propose further spans, which may overlap: anything around an
   ``@`` or a written-out (at), dotted numbers, and digit groups (as card and as phone).
3. Boosted trees (Spark ML) score a candidate from format (digits, groups, separators, plus,
   brackets, length, distinct digits) and context (characters beside it, cue words before
   it).  They are trained on the candidates of all documents: base spans, base
   spans rewritten into forms beyond the base rules, candidates that a cue, form or checksum
   confirms, against dates, identifiers and candidates that fail the check of their kind.
   What nothing tells has no label.  All are aggregated to distinct feature vectors.
4. On the other half of the documents each kind's threshold is calibrated on the candidates beyond
   the base spans: the least score whose candidates are right at least ``PRECISION`` of the time.  A kind that never
   reaches it adds nothing.
5. Trees and thresholds become one SQL expression, so finding and selecting are a single
   map over the whole texts, without shuffle, join or Python.

Positions are code points, end exclusive.  Spark has no find-all with positions, so spans
follow from the lengths of the matches and of the pieces between them.

Edge cases: null and empty texts have no span; documents without candidates, or with
one class only, gives no model and no additions; added spans never overlap base spans or
better added ones (ties: the earlier, then the kind as listed); repeated rows are treated
alike; an empty table has no row; extra columns are ignored by ``find_spans`` and kept by
``redact``.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.95
MIN_CALIBRATION = 20
TREES, DEPTH = 10, 3

# Same matches as the plain patterns, without their quadratic searches: a start inside a run of
# local-part characters (or digits) can only succeed if the start of the run does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

GENERATORS = {
    "email": [r"[^\s@<>\x22',;:()]{1,64}@[^\s@<>\x22',;:()]{1,255}",
              r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}|\x20(?:dot|DOT)\x20[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8}"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3,5}(?![0-9])", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"],
    "card": [r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"],
    "phone": [r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])"],
}
CUES = r"(?i)(?:phone|tel|call|fax|mobile|card|visa|credit|mail|contact|ip|host|server)\W{0,3}$"

#: words before a number that name an identifier, and the shapes of dates and times
ID_WORDS = r"(?i)(?:\bid|order|ref|no|nr|number|version|invoice|ticket|isbn)\W{0,3}$"
DATES = r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-./])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./])[01]?[0-9]\2(?:19|20)[0-9]{2})(?![0-9])"

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.cast("long").alias("start"), end.cast("long").alias("end"), x["match"].alias("match")))).alias("out"))

    paired = F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), m, lambda p, x: F.struct(p.alias("piece"), x.alias("match")))
    found = F.aggregate(paired, begin, step, lambda acc: acc["out"])
    return F.when(F.size(m) > 0, found).otherwise(F.array().cast(SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled (9 taken off above 9), the sum a multiple of 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    d = F.filter(d, lambda x: x.isNotNull())
    v = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(v, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (bare.cast("int") <= 255)


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {"email": F.lit(True), "ip": F.forall(F.split(x, r"\."), _small),
            "card": n.between(12, 19) & luhn(_digits(x)), "phone": n.between(9, 15)}[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base``: array of (start, order of the kind, end), sorted."""
    found = {"email": (EMAIL, F.contains("_text", F.lit("@"))), "ip": (IP, F.contains("_text", F.lit("."))), "card": (CARD, F.lit(True)),
             "phone": (PHONE, F.contains("_text", F.lit("+")))}
    for k, (pattern, possible) in found.items():
        docs = docs.withColumn(f"_{k}", F.when(possible, find_all(F.col("_text"), pattern)).otherwise(F.array().cast(SPAN)))
    def kept(i: int, k: str) -> Column:
        return F.transform(F.filter(f"_{k}", lambda s: _valid(k, s["match"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    parts = [kept(i, k) for i, k in enumerate(KINDS)]
    return docs.withColumn("_base", F.array_sort(F.concat(*parts))).drop(*[f"_{k}" for k in KINDS])


FEATURES = ["kind", "form", "digits", "size", "groups", "plus", "brackets", "dots", "distinct", "before", "after", "cue",
            "valid", "dated", "named"]


def _side(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).when(c.rlike("[.,;:!?]"), 4).otherwise(5))


def _features(kind: int, form: int, s: Column, text: Column) -> Column:
    x = s["match"]
    d = _digits(x)
    values = [F.lit(kind), F.lit(form), F.least(F.length(d), F.lit(25)), F.least(F.length(x), F.lit(40)),
              F.least(F.size(F.split(x, "[0-9]+", -1)) - 1, F.lit(9)), F.contains(x, F.lit("+")).cast("int"),
              x.rlike(r"[()\[\]]").cast("int"), F.least(F.size(F.split(x, r"\.", -1)) - 1, F.lit(9)),
              F.size(F.array_distinct(F.split(d, ""))), _side(F.when(s["start"] > 0, F.substring(text, s["start"].cast("int"), F.lit(1))).otherwise(F.lit(""))),
              _side(F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))),
              F.substring(text, F.greatest(s["start"] - 15, F.lit(1)).cast("int"), F.least(s["start"], F.lit(16)).cast("int")).rlike(CUES).cast("int")]
    lead = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)).cast("int"), F.least(s["start"], F.lit(16)).cast("int"))
    values += [_valid(KINDS[kind], x).cast("int") if (kind, form) != (1, 1) else F.lit(1), x.rlike(DATES).cast("int"), lead.rlike(ID_WORDS).cast("int")]
    return F.struct(s["start"].alias("start"), F.lit(kind).alias("order"), s["end"].alias("end"),
                    *[v.cast("int").alias(n) for n, v in zip(FEATURES, values)])


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``_base``) with ``_cand``: array of (start, order, end, features), base spans included."""
    def described(i: int, j: int) -> Column:
        return F.transform(f"_g{i}{j}", lambda s: _features(i, j, s, F.col("_text")))

    parts = []
    for i, k in enumerate(KINDS):
        for j, pattern in enumerate(GENERATORS[k]):
            need = F.contains("_text", F.lit("@")) if (k, j) == ("email", 0) else F.col("_text").rlike("[0-9]{2}|[(\\[]|:")
            docs = docs.withColumn(f"_g{i}{j}", F.when(need, find_all(F.col("_text"), pattern)).otherwise(F.array().cast(SPAN)))
            parts.append(described(i, j))
    out = docs.withColumn("_cand", F.concat(*parts))
    return out.drop(*[c for c in out.columns if re.fullmatch(r"_g\d\d", c)])


def weak_label() -> Column:
    """Label of a candidate ``c`` apart from the base spans; null if neither cue, form nor check tells."""
    return (F.when(F.expr("c.dated = 1 OR c.named = 1 OR c.valid = 0"), 0.0)
            .when(F.expr("c.kind = 2 OR c.form = 1 OR c.cue = 1"), 1.0))


def surroundings() -> Column:
    """Of every base span: its kind, up to 40 characters before and after it, and itself."""
    return F.expr("""transform(_base, b -> named_struct('kind', b.kind,
        'lead', substring(_text, cast(greatest(b.start - 39, 1) AS int), cast(least(b.start, 40) AS int)),
        'tail', substring(_text, cast(b.end + 1 AS int), 40),
        'x', substring(_text, cast(b.start + 1 AS int), cast(b.end - b.start AS int))))""")


def planted(near: DataFrame) -> DataFrame:
    """_h, _text, _span: the surroundings (``_near``) of each base span with the span rewritten, or a date or identifier in its place.

    Mail is written out, addresses become IPv6, cards are dotted, phone numbers lose the plus.  The kind of what is not personal
    is -1.
    """
    at = near.select("_h", F.explode("_near").alias("b")).select("_h", "b.*")
    digits = "lpad(cast(pmod(xxhash64(x, _h), 1000000000000) AS string), 12, '7')"
    day = "date_add(date'1990-01-01', cast(pmod(xxhash64(_h, x), 14000) AS int))"
    forms = f"""array(
        named_struct('kind', kind, 'lead', lead, 'x', CASE kind
            WHEN 0 THEN concat(split_part(x, '@', 1), ' (at) ', replace(split_part(x, '@', 2), '.', ' dot '))
            WHEN 1 THEN concat_ws(':', transform(sequence(0, 7), i -> substring(md5(x), 4 * i + 1, 4)))
            WHEN 2 THEN regexp_replace(x, '[ -]?([0-9]{{4}})(?=[0-9 -])', '$1.')
            ELSE substring(x, 2) END),
        named_struct('kind', kind, 'lead', lead, 'x', IF(kind = 0, concat(split_part(x, '@', 1), '[at]', split_part(x, '@', 2)), NULL)),
        named_struct('kind', -1, 'lead', lead, 'x', date_format({day}, 'yyyy-MM-dd HH:mm')),
        named_struct('kind', -1, 'lead', lead, 'x', date_format({day}, 'dd.MM.yyyy')),
        named_struct('kind', -1, 'lead', concat(lead, 'order '), 'x', {digits}),
        named_struct('kind', -1, 'lead', concat(lead, 'version '), 'x', concat_ws('.', split(substring({digits}, 1, 5), ''))))"""
    return at.select("_h", "tail", F.explode(F.expr(forms)).alias("f")).where("f.x IS NOT NULL").select(
        "_h", F.expr("concat(f.lead, f.x, tail)").alias("_text"),
        F.expr("named_struct('kind', f.kind, 'start', length(f.lead), 'end', length(f.lead) + length(f.x))").alias("_span"))


def train(docs: DataFrame) -> tuple[str, dict[int, float]] | None:
    """SQL of the trees' margin over a candidate ``c``, and each kind's least margin; None without two classes.

    All documents are read, in one pass that writes their spans, candidates and surroundings and no text.
    """
    based = base_spans(docs.select("_id", "_text")).select(F.xxhash64("_id", "_text", F.lit(2)).alias("_h"), "_text", "_base")
    near = cut(candidates(based).select("_h", "_base", "_cand", surroundings().alias("_near")).where(
        (F.size("_cand") > 0) | (F.size("_base") > 0)))
    found = near.select("_h", "_base", F.explode("_cand").alias("c"))
    same = F.expr("exists(_base, b -> b.start = c.start AND b.end = c.end AND b.kind = c.kind)")
    apart = F.expr("NOT exists(_base, b -> b.start < c.end AND c.start < b.end)")
    own = found.select("_h", F.when(same, 1.0).when(apart, weak_label()).alias("label"), (~same).cast("int").alias("beyond"), "c.*")
    # as in ``spans_of``, candidates that touch a base span (of a neighbour, say) are not there to choose from
    made = candidates(base_spans(planted(near))).select("_h", "_base", "_span", F.explode("_cand").alias("c")).where(
        "c.start < _span.end AND _span.start < c.end").where(apart)
    exact = F.expr("c.start = _span.start AND c.end = _span.end AND c.kind = _span.kind")
    drawn = made.select("_h", F.when(F.col("_span.kind") < 0, 0.0).when(exact, 1.0).alias("label"), F.lit(1).alias("beyond"), "c.*")
    rows = own.unionByName(drawn).where("label IS NOT NULL")
    # distinct feature vectors: bounded by the product of the features' ranges, in practice a few hundred
    table = cut(rows.groupBy(F.pmod("_h", F.lit(2)).alias("half"), "label", "beyond", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")))
    classes = {r[0] for r in table.where("half = 0").select("label").distinct().collect()}
    if classes != {0.0, 1.0}:
        return None
    wide = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="n", seed=1, stepSize=0.3).fit(wide.where("half = 0"))
    sql = margin_sql(model)
    scored = table.where("half = 1 AND beyond = 1").withColumn("m", F.round(F.expr(sql.replace("c.", "")), 9)).groupBy("kind", "m").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).collect()
    limits = {}
    for kind in range(len(KINDS)):
        n = right = 0.0
        for r in sorted((r for r in scored if r["kind"] == kind), key=lambda r: -r["m"]):
            n, right = n + r["n"], right + r["right"]
            if n >= MIN_CALIBRATION and right / n >= PRECISION:
                limits[kind] = r["m"]
    return sql, limits


def margin_sql(model: GBTClassificationModel) -> str:
    """The boosted trees as a sum of nested CASE expressions over ``c``."""
    def node(n) -> str:
        if n.subtreeDepth() == 0:
            return f"{n.prediction()!r}D"
        split = n.split()
        return (f"CASE WHEN c.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {node(n.leftChild())} "
                f"ELSE {node(n.rightChild())} END")

    return " + ".join(f"({w!r}D * {node(t._java_obj.rootNode())})" for t, w in zip(model.trees, model.treeWeights))


def find_spans(docs: DataFrame, id_col: str = "doc_id", model: tuple[str, dict[int, float]] | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind number, end); ``model`` as of ``train`` (trained here if None)."""
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("_text"))
    return spans_of(src, model if model is not None else train(src)).select(
        F.col("_id").alias(id_col), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def spans_of(src: DataFrame, model: tuple[str, dict[int, float]] | None) -> DataFrame:
    """``src`` (with ``_text``) with ``_base`` and ``_spans``."""
    based = base_spans(src)
    if not model or not model[1]:
        return based.withColumn("_spans", F.col("_base"))
    sql, limits = model
    passes = " OR ".join(f"(c.kind = {k} AND c.m >= {m!r}D)" for k, m in sorted(limits.items()))
    apart = "NOT exists(_base, b -> b.start < c.end AND c.start < b.end)"
    with_cand = candidates(based)
    # candidates apart from the base spans, then those past their kind's threshold, best first
    left = with_cand.withColumn("_cand", F.expr(f"filter(_cand, c -> {apart})"))
    scored = left.withColumn("_cand", F.expr(f"transform(_cand, c -> struct(round({sql}, 9) AS m, c.kind AS kind, c.start AS start, c.end AS end))"))
    kept = scored.withColumn("_cand", F.expr(
        f"array_sort(transform(filter(_cand, c -> {passes}), c -> struct(-c.m AS m, c.start AS start, c.kind AS kind, c.end AS end)))"))
    added = F.expr("aggregate(_cand, cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>), (a, c) -> "
                   "IF(exists(a, b -> b.start < c.end AND c.start < b.end), a, "
                   "concat(a, array(named_struct('start', c.start, 'kind', c.kind, 'end', c.end)))))")
    return kept.withColumn("_spans", F.array_sort(F.concat("_base", added))).drop("_cand")


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redact(docs: DataFrame, model: tuple[str, dict[int, float]] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become the first one's."""
    # the row travels whole beside the working columns, so no column of ``docs`` can clash with them
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("`text`"), F.lit("")).alias("_text"))
    if model is None:
        model = train(docs.select(F.col("`doc_id`").alias("_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("_text")))
    found = spans_of(src, model)
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    cleaned = F.expr(
        "aggregate(_spans, named_struct('at', 0L, 'out', ''), (a, s) -> IF(s.start < a.at, "
        "named_struct('at', greatest(a.at, s.end), 'out', a.out), "
        "named_struct('at', s.end, 'out', concat(a.out, substring(_text, cast(a.at + 1 AS int), cast(s.start - a.at AS int)), "
        f"element_at(array({names}), s.kind + 1)))), a -> concat(a.out, substring(_text, cast(a.at + 1 AS int))))")
    row = F.col("_row")
    text = F.when(F.size("_spans") > 0, cleaned).otherwise(row.getField("text"))
    return found.select(*[(text if c == "text" else row.getField(c)).alias(c) for c in docs.columns])
