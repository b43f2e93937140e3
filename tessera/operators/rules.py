"""Declarative rules over signal profiles, anomaly events and trouble codes: all conditions of a rule must hold."""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
CONDITIONS = ("stat_check", "anomaly_check", "dtc_check", "stat_compare", "signal_exists")
REQUIRED = ("id", "category", "severity", "description", "conditions", "template")


def validate(rules: list[dict], severities: tuple = ("low", "medium", "high", "critical"), categories: tuple | None = None) -> list[dict]:
    """The rules, if each has all keys, known severity, category and condition types, and an id of its own."""
    seen: set = set()
    for rule in rules:
        missing = [k for k in REQUIRED if k not in rule]
        if missing:
            raise ValueError(f"rule {rule.get('id')!r} lacks {missing}")
        if rule["severity"] not in severities or categories and rule["category"] not in categories:
            raise ValueError(f"rule {rule['id']!r} has an unknown severity or category")
        if not rule["conditions"] or any(c.get("type") not in CONDITIONS for c in rule["conditions"]):
            raise ValueError(f"rule {rule['id']!r} has no conditions or one of an unknown type")
        if rule["id"] in seen:
            raise ValueError(f"rule id {rule['id']!r} is used twice")
        seen.add(rule["id"])
    return rules


def _text(x) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null")) if isinstance(x, Column) else F.lit(str(x))


def _said(name, value) -> Column:
    return F.concat(F.lit(f"{name}="), _text(value))


def _condition(c: dict) -> tuple[Column, list[Column], dict]:
    """Whether a condition holds, its evidence, and what templates can name of it."""
    field = lambda signal, name: F.col("signals")[signal][name]
    if c["type"] == "stat_check":
        actual = field(c["signal"], c["field"])
        return OPERATORS[c["op"]](actual, F.lit(c["value"])), [_said(f"{c['signal']}.{c['field']}", actual)], {}
    if c["type"] == "stat_compare":
        ratio = c.get("ratio", 1.0)
        a, b = field(c["signal_a"], c["field_a"]), field(c["signal_b"], c["field_b"])
        said = [_said(f"{c['signal_a']}.{c['field_a']}", a), _said(f"{c['signal_b']}.{c['field_b']}", b), _said("ratio", ratio)]
        return OPERATORS[c["op"]](a, b * ratio), said, {}
    if c["type"] == "signal_exists":
        present = F.map_contains_key("signals", F.lit(c["signal"]))
        return present == F.lit(c.get("exists", True)), [_said(f"{c['signal']}_present", present)], {}
    if c["type"] == "anomaly_check":
        filters = {k: c[k] for k in ("signal", "context", "severity") if c.get(k)}

        def fits(e):
            tests = [F.array_contains(e["signals"], v) if k == "signal" else e[k] == v for k, v in filters.items()]
            return reduce(lambda a, b: a & b, tests, F.lit(True))

        count = F.size(F.filter("anomalies", fits))
        holds = count >= c["min_count"] if c.get("min_count") is not None else count <= c["max_count"] if "max_count" in c else count > 0
        return holds, [_said("anomaly_events_matched", count), *(_said(f"anomaly_{k}_filter", v) for k, v in filters.items())], {"anomaly_count": count.cast("string")}
    if c["type"] == "dtc_check":
        mode, prefix, code = c.get("mode", "present"), c.get("prefix", ""), c.get("code", "")
        codes, n = F.col("codes"), F.size("codes")
        found = F.array_join(F.filter(codes, lambda x: x.startswith(prefix)), ", ")
        some = F.exists(codes, lambda x: x.startswith(prefix))
        if mode == "absent":
            return n == 0, [_said("dtc_count", n)], {"matched_dtcs": F.lit("")}
        if mode == "prefix":
            return some, [_said("dtc_prefix", prefix), _said("dtc_matched", found)], {"matched_dtcs": found}
        if mode == "absent_prefix":
            return ~some, [_said("dtc_absent_prefix", prefix), _said("dtc_matched", found)], {"matched_dtcs": F.lit("")}
        if mode == "present" and code:
            there = F.array_contains(codes, code)
            return there, [_said("dtc_code", code), _said("dtc_present", there)], {"matched_dtcs": F.when(there, code).otherwise("")}
        if mode == "present":
            return n > 0, [_said("dtc_count", n)], {"matched_dtcs": F.array_join(codes, ", ")}
    raise ValueError(f"unknown condition {c!r}")


def rendered(template: str, otherwise: str, names: dict) -> Column:
    """a template with ``{signal.field}``, ``{signal.field:.1f}`` and plain names put in. A plain name that
    is not known reads N/A; a field of an unknown signal makes the whole text ``otherwise``."""
    parts, needed = [], []
    for literal, name, spec, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is None:
            continue
        signal, _, field = name.partition(".")
        if field:
            value = F.col("signals")[signal][field]
            needed.append(F.map_contains_key("signals", F.lit(signal)))
            parts.append(F.coalesce(F.format_string(f"%{spec}", value.cast("double")) if spec else value.cast("string"), F.lit("nan")))
        else:
            parts.append(names.get(name, F.lit("N/A")))
    whole = F.concat(*parts)
    return F.when(reduce(lambda a, b: a & b, needed), whole).otherwise(otherwise) if needed else whole


def evaluate(profiles: DataFrame, rules: list[dict], fields: list[str], anomalies: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(session, rule, category, severity, nth, clue, evidence) of the rules that hold for each session, in rule order.

    ``profiles``: session, signal and ``fields``; ``anomalies``: session, signals array, context, severity;
    ``codes``: session, code. What belongs to a session becomes one row, bounded by its signals, anomaly
    events and codes. A condition on a signal that is absent, or on a null field, does not hold. Sessions
    are those of the profiles.
    """
    entry = F.struct("signal", F.struct(*fields))
    sessions = profiles.groupBy("session").agg(F.map_from_entries(F.collect_list(entry)).alias("signals"))
    kind = "array<struct<signals:array<string>,context:string,severity:string>>"
    if anomalies is not None:
        found = anomalies.groupBy("session").agg(F.collect_list(F.struct("signals", "context", "severity")).cast(kind).alias("anomalies"))
        sessions = sessions.join(found, "session", "left")
    if codes is not None:
        sessions = sessions.join(codes.groupBy("session").agg(F.array_sort(F.collect_set("code")).alias("codes")), "session", "left")
    none = lambda name, of: F.coalesce(name, F.array().cast(of)) if name in sessions.columns else F.array().cast(of)
    sessions = sessions.withColumn("anomalies", none("anomalies", kind)).withColumn("codes", none("codes", "array<string>"))
    hits = []
    for k, r in enumerate(rules):
        tests, said, names = [], [], {"anomaly_count": F.lit("0"), "matched_dtcs": F.lit("")}
        for c in r["conditions"]:
            holds, evidence, more = _condition(c)
            tests.append(F.coalesce(holds, F.lit(False)))
            said += evidence
            names |= more
        clue = rendered(r.get("template", r["id"]), r.get("description", r["id"]), names)
        fields_ = [F.lit(r[f]).alias(a) for f, a in (("id", "rule"), ("category", "category"), ("severity", "severity"))]
        hits.append(F.when(reduce(lambda a, b: a & b, tests), F.struct(*fields_, F.lit(k).alias("nth"), clue.alias("clue"), F.array(*said).alias("evidence"))))
    return sessions.select("session", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("session", "h.*")
