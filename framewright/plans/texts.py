"""Queries of the text rules. CASE chains and regular expressions stay in the JVM; the rest runs in Arrow batches."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions import captions as C
from framewright.functions import vocabulary as V
from framewright.plans.registry import query
from framewright.sources.adapters import captions, table

# ---------------------------------------------------------------- column forms


def punctuation(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s*,\s*", ", "), r",\s*and\s+", " and "), r"\band then\b", "and")


def merged(left: Column, right: Column, both: Column) -> Column:
    """The joint text unless it is blank or "n/a"; else the longer of left and right, right on a tie."""
    some = lambda c: F.when((F.trim(c) != "") & (c != "n/a"), c)
    a, b = some(left), some(right)
    longer = F.when(F.coalesce(F.length(a), F.lit(0)) > F.coalesce(F.length(b), F.lit(0)), a).otherwise(b)
    return F.coalesce(some(both), longer, F.lit("n/a"))


def chain(text: Column, rules: list[tuple[tuple[str, ...], str]], other: str) -> Column:
    """Code of the first rule of which a keyword occurs in the text."""
    out = None
    for words, code in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(other)


def gate_code(reason: Column) -> Column:
    r = F.trim(F.lower(F.coalesce(reason, F.lit(""))))
    return F.when(r.isin("n/a", ""), "text_gate_other").otherwise(F.concat(F.lit("text_gate_"), chain(r, [((w,), c) for w, c in V.TEXT_GATE], "other")))


def reason_code(reason: Column, whole: Column) -> Column:
    """Code of a free-text reason; `whole`: the window was rejected, not a field."""
    r = F.trim(F.lower(F.coalesce(reason, F.lit(""))))
    g = F.trim(F.regexp_replace(r, r"^global:", ""))
    ing = r"\b(?:" + "|".join(V.TOOL_ING) + r")\b"

    def tool(t: Column) -> Column:
        hit = F.regexp_like(t, F.lit(ing))
        for w in V.TOOL_WORDS:
            hit = hit | F.contains(t, F.lit(w))
        return hit

    any_of = lambda t, ws: chain(t, [(tuple(ws), "y")], "n") == "y"
    tagged = F.when(F.lit(False), "")
    for t in V.GLOBAL_TAGS:
        tagged = tagged.when(g.startswith(t), t)
    tagged = tagged.when(any_of(g, V.PERSON_WORDS), "other_person").when(any_of(g, V.SELF_WORDS), "self_contact").when(F.contains(g, F.lit("walk")), "walking")
    tagged = tagged.when(any_of(g, ("dark", "unclear", "blurry")), "dark").when(tool(g) | F.contains(g, F.lit("tool")), "continuous_tool").otherwise("other")
    free = F.when(any_of(r, V.PERSON_WORDS), F.when(whole, "other_person").otherwise("untracked")).when(any_of(r, V.SELF_WORDS), F.when(whole, "self_contact").otherwise("other"))
    free = free.when(F.contains(r, F.lit("walk")), "walking").when(any_of(r, ("dark", "unclear", "blurry")), "dark").when(tool(r), "continuous_tool")
    free = free.otherwise(chain(r, list(V.FREE_CODES), "other"))
    code = F.when(r == "parse_error", "parse_error").when(r.startswith("global:"), tagged).otherwise(free)
    return F.concat(F.lit("vlm_verify_"), code)


def mentions(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.regexp_like(text, F.lit(C._pattern(patterns).pattern.replace(r"\ ", " ")))


def unfenced(raw: Column) -> Column:
    """Without a code fence, and with the prefix that a forced beginning has taken."""
    s = F.trim(raw)
    body = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"\s*```\s*$", "")
    inner = F.when(s.startswith("```"), body).otherwise(raw)
    return F.when(F.ltrim(inner).startswith("{"), inner).otherwise(F.concat(F.lit('{"think":"'), inner))


# ---------------------------------------------------------------- queries

_CAP = """cp AS (SELECT p_partkey AS cap_id, CASE WHEN p_partkey % 3 = 0 THEN a || ' and ' || ['pick', 'hold', 'move', 'open', 'carry', 'look', 'place', 'cut'][p_size % 8 + 1] || ' it' WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE a END AS text, p_size, p_brand
FROM (SELECT *, ['pick', 'hold', 'move', 'open', 'carry', 'look', 'place', 'cut'][p_partkey % 8 + 1] || ' the ' || p_name AS a FROM part))"""
_PUNCT = "regexp_replace(regexp_replace(regexp_replace(t, '\\s*,\\s*', ', ', 'g'), ',\\s*and\\s+', ' and ', 'g'), '\\band then\\b', 'and', 'g')"


@query(f"WITH {_CAP}, x AS (SELECT cap_id, replace(replace(text, ' the ', ' , the ,'), ' and ', ', and then ') AS t FROM cp) SELECT cap_id, {_PUNCT} AS text FROM x")
def normalize_punct(spark, d):
    c = captions(spark, d)
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" , the ,")), F.lit(" and "), F.lit(", and then "))
    return c.select("cap_id", punctuation(t).alias("text"))


_parts = C.column(lambda s: C.phrases(s, cut=True), "array<string>")


@query()
def split_actions(spark, d):
    return captions(spark, d).select("cap_id", F.posexplode(_parts(F.col("text"))).alias("place", "phrase"))


@query("""SELECT p_partkey AS cap_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' and ' || p_brand ELSE p_name || ', ' || p_brand || ' and ' || p_type END AS text FROM part""")
def rejoin_actions(spark, d):
    p = table(spark, d, "part")
    ps = F.slice(F.array("p_name", "p_brand", "p_type"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.when(F.size(ps) == 1, F.element_at(ps, 1)).otherwise(F.concat(F.array_join(F.slice(ps, F.lit(1), F.size(ps) - 1), ", "), F.lit(" and "), F.element_at(ps, -1)))
    return p.select(F.col("p_partkey").alias("cap_id"), text.alias("text"))


_class = C.column(lambda s: C.object_class(tuple(s.lower().split())))


@query("""SELECT p_partkey AS cap_id, CASE WHEN p_partkey % 4 > 1 THEN 'concrete' WHEN regexp_full_match(split_part(p_name, ' ', 1), 'small|large|red|green|blue|black|white|heavy|light|big') AND split_part(p_name, ' ', 1) <> 'heavy' THEN 'appearance_only' ELSE 'typed_generic' END AS class FROM part WHERE p_partkey % 4 > 1 OR true""")
def classify_object(spark, d):
    p = table(spark, d, "part")
    words = F.when(F.col("p_partkey") % 4 > 1, F.col("p_name")).otherwise(F.concat(F.split("p_name", " ")[0], F.lit(" thing")))
    return p.select(F.col("p_partkey").alias("cap_id"), _class(words).alias("class"))


_reason = C.column(lambda s: C.caption_reason(s, may_hold=True) or "ok")


@query()
def validate_phrase(spark, d):
    return captions(spark, d).groupBy(_reason(F.col("text")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CAP} SELECT cap_id, regexp_matches(text || ' left hands', '\\bleft hands?\\b') AS hand, regexp_matches(text || ' left handle', '\\bleft hands?\\b') AS handle, regexp_matches(text, '\\bit\\b') AS it FROM cp")
def pattern_flags(spark, d):
    t = F.col("text")
    hand = lambda tail: mentions(F.concat(t, F.lit(tail)), V.HAND_REFERENCES)
    return captions(spark, d).select("cap_id", hand(" left hands").alias("hand"), hand(" left handle").alias("handle"), F.regexp_like(t, F.lit(r"\bit\b")).alias("it"))


_generic = C.column(lambda s: C.is_generic(C.Phrase(s)), "boolean")


@query("SELECT p_partkey AS cap_id, p_partkey % 2 = 0 AS generic FROM part")
def generic_summary(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("cap_id"), _generic(F.when(F.col("p_partkey") % 2 == 0, F.lit("organize the items")).otherwise(F.concat(F.lit("arrange the "), F.split("p_name", " ")[1], F.lit(" up")))).alias("generic"))


_anchor = C.column(lambda s: " ".join(sorted(C.anchors(C.Phrase(s)))))


@query(f"""WITH x AS (SELECT p_partkey AS cap_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT cap_id, CASE WHEN a IN ({', '.join(f"'{w}'" for w in sorted(V.WEAK_ADJECTIVES))}) THEN b ELSE least(a, b) || ' ' || greatest(a, b) END AS noun FROM x""")
def anchor_nouns(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("cap_id"), _anchor(F.concat(F.lit("pick up the "), F.col("p_name"), F.lit(" from the table"))).alias("noun"))


@query("""WITH q AS (SELECT p_partkey AS cap_id, CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE p_name END AS l, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS r, CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE 'n/a' END AS b FROM part),
s AS (SELECT cap_id, CASE WHEN trim(l) <> '' AND l <> 'n/a' THEN l END AS l, CASE WHEN trim(r) <> '' AND r <> 'n/a' THEN r END AS r, CASE WHEN trim(b) <> '' AND b <> 'n/a' THEN b END AS b FROM q)
SELECT cap_id, coalesce(b, CASE WHEN coalesce(length(l), 0) > coalesce(length(r), 0) THEN l ELSE r END, 'n/a') AS text FROM s""")
def merge_narration(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    left, right, both = F.when(k % 4 == 0, "n/a").otherwise(F.col("p_name")), F.when(k % 5 == 0, "").otherwise(F.col("p_brand")), F.when(k % 6 == 0, F.col("p_type")).otherwise("n/a")
    return p.select(k.alias("cap_id"), merged(left, right, both).alias("text"))


@query("""SELECT p_partkey AS cap_id, CASE p_partkey % 3 WHEN 0 THEN '{"left":"' || p_name || '"}' WHEN 1 THEN '{"right":"' || p_name || '"}' ELSE '{"think":"' || p_name || '"}' END AS text FROM part""")
def strip_fence(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("cap_id"), unfenced(_fenced()).alias("text"))


def _fenced() -> Column:
    k, n = F.col("p_partkey"), F.col("p_name")
    return F.when(k % 3 == 0, F.concat(F.lit('```json\n{"left":"'), n, F.lit('"}\n```  '))).when(k % 3 == 1, F.concat(F.lit('{"right":"'), n, F.lit('"}'))).otherwise(F.concat(n, F.lit('"}')))


_NARRATION = "struct<think:string,left:string,right:string,bimanual:string,reason:string>"


def _narrated(s: str) -> dict:
    out, reason = C.narration(s)
    return {**out, "reason": reason}


def narration(text: Column) -> Column:
    """Struct of the fields of an answer and why it is none."""
    return F.from_json(C.column(lambda s: json.dumps(_narrated(s)))(text), _NARRATION)


@query("""SELECT p_partkey AS cap_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'n/a' END AS l, CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE 'n/a' END AS r, CASE WHEN p_partkey % 3 = 2 THEN 'missing_left_right' END AS reason FROM part""")
def json_perhand(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("cap_id"), narration(unfenced(_fenced())).alias("x"))
    return q.select("cap_id", F.col("x.left").alias("l"), F.col("x.right").alias("r"), "x.reason")


def _flagged(s: str) -> str:
    got, reason = C.flags(s, ("left", "bimanual"), "_na")
    return reason if not got else ",".join(f"{k}={str(v).lower()}" for k, v in sorted(got.items()))


_flags = C.column(_flagged)


@query("""SELECT p_partkey AS cap_id, CASE p_partkey % 4 WHEN 0 THEN 'bimanual_na=true,global_na=true,left_na=true' WHEN 1 THEN 'bimanual_na=false,left_na=true' ELSE 'parse_error' END AS flags FROM part""")
def parse_flags(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, '{"global_na": true, "reason": "dark"}').when(k % 4 == 1, '{"a":1} {"left_na": "True", "bimanual_na": false, "right_na": true}').when(k % 4 == 2, '{"left_na": true}').otherwise("none")
    return table(spark, d, "part").select(k.alias("cap_id"), _flags(raw).alias("flags"))


_REASONS = ["global: walking fast", "global:other_person", "another person holds it", "worn items", "too dark", "uses a drill", "repetitive motion", "only hold", "not visible here", "ambiguous shape", "hovering", "misaligned box", "bimanual unclear object", "ironing cloth", "parse_error", "fine", "global: rule 9", "environment", "summary of tools", "weak claim"]


def _pick(d, spark):
    return table(spark, d, "part").select(F.col("p_partkey").alias("cap_id"), F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("p_partkey") % len(_REASONS) + 1).cast("int")).alias("reason"))


_CODES = ["walking", "other_person", "untracked", "other", "dark", "continuous_tool", "continuous_generic", "stabilizing", "inconsistent", "unclear_object", "no_contact", "untracked", "dark", "continuous_tool", "parse_error", "other", "self_contact", "other", "other", "other"]


@query(f"SELECT p_partkey AS cap_id, 'vlm_verify_' || {_CODES}[p_partkey % {len(_CODES)} + 1] AS code FROM part")
def classify_reason(spark, d):
    return _pick(d, spark).select("cap_id", reason_code(F.col("reason"), F.lit(False)).alias("code"))


@query(f"""WITH r AS (SELECT p_partkey AS cap_id, {_REASONS}[p_partkey % {len(_REASONS)} + 1] AS t FROM part)
SELECT cap_id, 'text_gate_' || CASE {' '.join(f"WHEN contains(t, '{w}') THEN '{c}'" for w, c in V.TEXT_GATE)} ELSE 'other' END AS code FROM r""")
def classify_text_gate(spark, d):
    return _pick(d, spark).select("cap_id", gate_code(F.col("reason")).alias("code"))


_normal = C.column(C.normal_form)


@query()
def normalize_caption(spark, d):
    return captions(spark, d).select("cap_id", _normal(F.col("text")).alias("text"))


_valid = C.column(lambda s: json.dumps({**(r := C.validated(json.loads(s)))[0], "reason": r[2]}))


@query()
def validate_perhand(spark, d):
    t = F.col("text")
    q = captions(spark, d).select("cap_id", F.from_json(_valid(F.to_json(F.struct(t.alias("left"), F.replace(t, F.lit("the"), F.lit("a")).alias("right"), t.alias("bimanual")))), _NARRATION).alias("x"))
    return q.select("cap_id", "x.left", "x.right", "x.bimanual", "x.reason")


_last = C.column(lambda s: C.last_object(s, ("left", "right"), any_key=True))


@query()
def last_json_object(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit('note {"left":"a } brace","x":{"y":1}} and {"other":"'), F.col("p_name"), F.lit('"}'))
    return p.select(F.col("p_partkey").alias("cap_id"), _last(raw).alias("object"))


_post = C.column(lambda s: json.dumps(C.postchecked(json.loads(s))[0]))


@query()
def postcheck(spark, d):
    t = F.col("text")
    both = F.when(F.col("cap_id") % 5 == 0, "lift something").otherwise(t)
    return captions(spark, d).select("cap_id", F.from_json(_post(F.to_json(F.struct(t.alias("left"), F.lit("n/a").alias("right"), both.alias("bimanual")))), "left string, right string, bimanual string").alias("x")).select("cap_id", "x.*")
