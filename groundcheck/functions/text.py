"""Wording of warnings, scores and narratives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from groundcheck.fixed_values import SEVERITY_HIGH_RATIO, SEVERITY_MEDIUM_RATIO


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounding the stored binary value half to even.

    ``format_string`` rounds the shortest decimal form instead, which differs at ties; ``format_number`` rounds
    the value that is stored, as long as its shortest form has all the places that are shown and starts before
    the last of them.  Elsewhere the fraction is cut into two exact integers (30 and 40 binary places), so integer
    arithmetic decides the rounding.
    """
    if not 1 <= digits <= 3:
        raise ValueError("digits must be 1, 2 or 3")
    size = F.abs(value.cast("double"))
    plain = F.translate(F.format_number(size, digits), ",", "")
    ten, high, low = 10**digits, 1 << 30, 1 << 40
    whole = F.floor(size)
    scaled = (size - whole) * float(high)
    top = F.floor(scaled)
    tail = F.floor((scaled - top) * float(low)) * ten
    units = top * ten + F.shiftright(tail, 40)
    beyond = tail % low
    kept = F.shiftright(units, 30)
    rest = units % high
    up = (rest > high // 2) | (
        (rest == high // 2) & ((beyond > 0) | (kept % 2 == 1)))
    kept = kept + up.cast("bigint")
    carry = (kept >= ten).cast("bigint")
    exact = F.concat(
        (whole + carry).cast("string"), F.lit("."), F.lpad((kept - carry * ten).cast("string"), digits, "0"))
    return F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.when((size >= 10.0**-digits) & (size < 2.0**40), plain).otherwise(exact))


def short_number(value: Column) -> Column:
    """Up to three decimals without trailing zeros."""
    return F.rtrim(F.rtrim(fixed(value, 3), F.lit("0")), F.lit("."))


def severity(ratio: Column) -> Column:
    return (
        F.when(ratio >= SEVERITY_HIGH_RATIO, "high")
        .when(ratio >= SEVERITY_MEDIUM_RATIO, "medium")
        .otherwise("low"))


def overlap_text(synthetic: Column, a: Column, b: Column, area: Column) -> Column:
    shown = fixed(area, 1)
    return F.when(synthetic, F.concat(
        F.lit("Demonstration Warning: Synthetic polygons "), a, F.lit(" and "), b,
        F.lit(" overlap spatially by approximately "), shown,
        F.lit(" m². Requires human vertex reconciliation."),
    )).otherwise(F.concat(
        F.lit("Spatial overlap detected between polygon "), a, F.lit(" and polygon "), b,
        F.lit(" (approx "), shown, F.lit(" m²). Review boundaries visually.")))


def road_text(synthetic: Column, building: Column, road: Column, area: Column) -> Column:
    shown = fixed(area, 1)
    return F.when(synthetic, F.concat(
        F.lit("Demonstration Warning: Spatial overlap detected between synthetic building "),
        building, F.lit(" and synthetic road corridor "), road, F.lit(" (approx "), shown,
        F.lit(" m²)—review visually."),
    )).otherwise(F.concat(
        F.lit("Spatial overlap detected between building "), building,
        F.lit(" and road corridor "), road, F.lit(" (approx "), shown,
        F.lit(" m²)—review visually. Road corridors and centerlines are spatial references, "
              "not legal rights-of-way.")))


def crossing_text(synthetic: bool, building: Column, parcel: Column, locality: str) -> Column:
    if synthetic:
        return F.concat(
            F.lit("Demonstration Warning: Synthetic building footprint "), building,
            F.lit(" crosses boundary of synthetic parcel "), parcel,
            F.lit(f". This is a demonstration fixture; real {locality} parcel dataset is 0 features."))
    return F.concat(
        F.lit("Building footprint "), building, F.lit(" crosses parcel boundary "), parcel,
        F.lit(". Review boundaries visually against imagery."))


def outside_text(building: Column, parcel: Column, distance: Column) -> Column:
    return F.concat(
        F.lit("Building footprint "), building, F.lit(" is "), fixed(distance, 2),
        F.lit(" m from the nearest loaded parcel boundary "), parcel, F.lit("."))


def low_confidence_text(confidence: Column, threshold: float) -> Column:
    return F.concat(
        F.lit("AI detection confidence is "), fixed(confidence, 2),
        F.lit(f", below the {threshold:.2f} review threshold."))


_HIDDEN = ("geometry_type", "validity_reason", "parse_error", "nearest_parcel_id")


def narrate(
    warning_type: Column, feature_ids: Column, explanation: Column, evidence: Column,
    tolerance: Column, action_text: Column,
) -> Column:
    """One paragraph describing a warning from its own fields.

    ``evidence`` is ``array<struct<name,number,text>>``; ``tolerance`` is
    ``struct<name,value,unit,flag>`` where ``flag`` replaces the value for yes/no tolerances.
    """
    unit = F.coalesce(tolerance["unit"], F.lit(""))

    def shown(item: Column) -> Column:
        measured = item["name"].endswith("_m") | item["name"].endswith("_m2")
        raw = F.coalesce(short_number(item["number"]), item["text"], F.lit("None"))
        label = F.when(measured, F.regexp_replace(item["name"], "(_m)?(_m2)?$", "")).otherwise(item["name"])
        return F.concat(
            F.translate(label, "_", " "), F.lit(": "),
            F.trim(F.concat(raw, F.lit(" "), F.when(measured, unit).otherwise(""))))

    def detail(name: str) -> Column:
        return F.get(F.filter(evidence, lambda e: e["name"] == name), F.lit(0))["text"]

    def sentence(prefix: str, body: Column, suffix: str = ".") -> Column:
        return F.coalesce(F.concat(F.lit(prefix), body, F.lit(suffix)), F.lit(""))

    kind = F.lower(F.translate(F.coalesce(warning_type, F.lit("review rule")), "_", " "))
    head = F.concat(F.upper(F.substring(kind, 1, 1)), kind.substr(F.lit(2), F.length(kind)))
    named = F.when(F.size(feature_ids) > 0, F.concat(
        F.lit(" for feature(s) "), F.array_join(feature_ids, ", "))).otherwise("")
    details = F.filter(evidence, lambda e: ~e["name"].isin(*_HIDDEN))
    measured = F.when(F.size(details) > 0, F.array_join(F.transform(details, shown), "; "))
    limit = F.coalesce(tolerance["flag"], short_number(tolerance["value"]))
    tolerance_text = F.concat(
        F.translate(tolerance["name"], "_", " "), F.lit(" is "),
        F.trim(F.concat(limit, F.lit(" "), unit)))
    text = F.concat(
        head, named, F.lit("."),
        sentence(" Measured evidence: ", measured),
        sentence(" Validity detail: ", detail("validity_reason")),
        sentence(" Parse detail: ", detail("parse_error")),
        sentence(" Review tolerance: ", tolerance_text),
        sentence(" Suggested action: ", F.regexp_replace(action_text, r"[.!?]+$", "")))
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, text).otherwise(explanation)
