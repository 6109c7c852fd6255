"""Classification of call sites by declarative rules: the first rule, in order, whose conditions hold.

Rules are the user's data (``from_toml`` or any table of RULES). An api pattern is resolved once against the distinct
apis, which are few; each api's rules become one array in order, which sites get by an equality join, so that the first
match is the first element whose predicates hold, without a shuffle of the sites.
"""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import algorithm_rows
from ..functions.text import fill_template, stable_id

RULES = (
    "lang string, ord int, rule_id string, api string, contexts array<string>, imports array<string>, "
    "preds array<struct<key: string, kind: string, i: bigint, s: string, lt: bigint, le: bigint, gt: bigint, ge: bigint>>, "
    "algorithm_id string, severity_hint string, message string, cwe string"
)


def predicate(key: str, want) -> tuple:
    """A rule file's condition on one argument: an integer, a string, {regex = ...} or bounds."""
    if isinstance(want, int):
        return (key, "int", want, None, None, None, None, None)
    if isinstance(want, str):
        return (key, "str", None, want, None, None, None, None)
    if "regex" in want:
        return (key, "regex", None, want["regex"], None, None, None, None)
    if extra := set(want) - {"lt", "le", "gt", "ge"}:
        raise ValueError(f"unknown condition {sorted(extra)}")
    return (key, "range", None, None, want.get("lt"), want.get("le"), want.get("gt"), want.get("ge"))


def from_toml(spark: SparkSession, lang: str, text: str) -> DataFrame:
    """Rules of one language, in file order: [[classify]] with id, when.{api, args, site_context, imports}, algorithm, message.
    A rule of an algorithm that the table does not have is an error."""
    rows, known = [], {a[0] for a in algorithm_rows()}
    for i, r in enumerate(tomllib.loads(text).get("classify", [])):
        when = r["when"]
        if r["algorithm_id"] not in known:
            raise ValueError(f"rule {r['id']}: unknown algorithm {r['algorithm_id']}")
        preds = [predicate(k, v) for k, v in when.get("args", {}).items()]
        rows.append((lang, i, r["id"], when["api"], when.get("site_context"), when.get("imports"), preds, r["algorithm_id"], r.get("severity_hint"), r.get("message", ""), r.get("cwe")))
    return spark.createDataFrame(rows, RULES)


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all files ``<language>.toml`` of a folder that Spark reads; C and C++ share a pack, as do JavaScript and
    TypeScript."""
    same = {"cpp": ["c", "cpp"], "javascript": ["javascript", "typescript"]}
    found = spark.read.text(path, wholetext=True, pathGlobFilter="*.toml").select(F.input_file_name().alias("file"), "value").collect()  # a file a language
    packs = [from_toml(spark, own, r.value) for r in found for lang in [r.file.rpartition("/")[2].removesuffix(".toml")] for own in same.get(lang, [lang])]
    if not packs:
        raise ValueError(f"{path}: no rules")
    return reduce(DataFrame.unionByName, packs)


def _matcher(patterns: list[str]):
    """matches(text, number): whether the text matches the pattern of that place in the list. Patterns are constants of the
    plan, so each is compiled once; a rule pack has few."""

    def matches(text: Column, number: Column) -> Column:
        found = [F.when(number == i, text.rlike(p)) for i, p in enumerate(patterns)]
        return F.coalesce(*found) if found else F.lit(None).cast("boolean")

    return matches


def _holds(p: Column, args: Column, matches) -> Column:
    """One predicate on the captured arguments (map<string, struct<i, s>>); another type or no argument does not match."""
    a = F.try_element_at(args, p["key"])
    in_range = (
        (p["lt"].isNull() | (a["i"] < p["lt"])) & (p["le"].isNull() | (a["i"] <= p["le"])) & (p["gt"].isNull() | (a["i"] > p["gt"])) & (p["ge"].isNull() | (a["i"] >= p["ge"]))
    )
    held = F.when(p["kind"] == "int", a["i"] == p["i"]).when(p["kind"] == "str", a["s"] == p["s"]).when(p["kind"] == "regex", matches(a["s"], p["i"])).when(p["kind"] == "range", a["i"].isNotNull() & in_range)
    return F.coalesce(held, F.lit(False))


#: An api pattern that stands for one name: anchored, of plain and escaped characters.
_NAME = r"^\^(?:[\w/: -]|\\[^\w\s])*\$$"


def resolve(rules: DataFrame, apis: DataFrame) -> DataFrame:
    """Rules with the api each pattern matches. apis: lang, api (distinct and few: an extractor's closed surface). A pattern of
    one name is joined by that name; only the rest is held against the apis of its language."""
    named = rules.withColumnRenamed("api", "pattern")
    plain = F.col("pattern").rlike(_NAME)
    name = F.regexp_replace(F.regexp_replace("pattern", r"^\^|\$$", ""), r"\\(.)", "$1")
    apis = apis.distinct()
    exact = apis.join(named.where(plain).withColumn("api", name), ["lang", "api"]).select("lang", "api", *[c for c in named.columns if c != "lang"])
    rest = apis.join(named.where(~plain), "lang").where(F.rlike("api", F.col("pattern"))).select(exact.columns)
    return exact.unionByName(rest)


def classify(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each match that some rule takes. matches: match_id, lang, api, args, site_context, imports."""
    # A rule pack's patterns; sites are held against constants, never against a pattern of another column.
    regexes = rules.select(F.explode("preds").alias("p")).where("p.kind = 'regex'").select("p.s").unionByName(rules.select(F.explode("imports").alias("s"))).distinct()
    patterns = sorted(r.s for r in regexes.collect())
    fits_pattern, place = _matcher(patterns), F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")
    number = lambda text: (F.array_position(place, text) - 1).cast("long")
    numbered = F.transform("preds", lambda p: F.when(p["kind"] == "regex", p.withField("i", number(p["s"]))).otherwise(p))
    rules = resolve(rules.withColumns({"preds": numbered, "imports": F.transform("imports", number)}), matches.select("lang", "api"))
    rule = F.struct("ord", "rule_id", "contexts", F.col("imports").alias("wanted"), "preds", "algorithm_id", "message")
    listed = rules.groupBy("lang", "api").agg(F.array_sort(F.collect_list(rule)).alias("rules"))  # a rule pack's rows
    sites = matches.select("match_id", "lang", "api", "args", "site_context", "imports").join(listed, ["lang", "api"])

    def fits(r):
        context = r["contexts"].isNull() | F.array_contains(r["contexts"], F.col("site_context"))
        imported = r["wanted"].isNull() | F.coalesce(F.exists("imports", lambda i: F.exists(r["wanted"], lambda w: fits_pattern(i, w))), F.lit(False))
        return context & imported & F.coalesce(F.forall(r["preds"], lambda p: _holds(p, F.col("args"), fits_pattern)), F.lit(True))

    found = sites.withColumn("hit", F.try_element_at(F.filter("rules", fits), F.lit(1))).where("hit IS NOT NULL")
    text = F.transform_values("args", lambda k, v: F.coalesce(v["s"], v["i"].cast("string")))
    return found.select("match_id", "hit.rule_id", "hit.algorithm_id", fill_template(F.col("hit.message"), text).alias("message"))


def unknown_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id and findings of the rules that findings name but the rules do not have: must be empty."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("findings")).join(rules.select("rule_id").distinct(), "rule_id", "left_anti")


def as_findings(classified: DataFrame, matches: DataFrame) -> DataFrame:
    """Findings of classified matches, with the constants of source scans."""
    both = classified.join(matches.select("match_id", "path", "line", "offset", "symbol", "snippet"), "match_id")
    ident = stable_id(*[F.col(c) for c in ("rule_id", "algorithm_id", "path", "line", "symbol")])
    return both.select(
        ident.alias("id"), "rule_id", "algorithm_id", F.col("path").alias("location"), "line", "offset", "symbol", "snippet", "message",
        F.lit("literal_arg").alias("confidence"), F.lit("unknown").alias("usage_context"), F.lit("internal_service").alias("exposure"), F.lit("short").alias("shelf_life_bucket"),
    )
