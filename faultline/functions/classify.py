"""Rule-based classification of failure types, causes and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_key, normalize_spaces

# Words that decide the discipline, the first list that matches wins.
DISCIPLINES = {
    "HW": ("electronics", "electronic", "electrical", "hw", "hardware"),
    "MCH": ("mechanics", "mechanical", "mech", "mch"),
    "ESW": ("software", "sw", "firmware", "embedded software", "esw"),
    "process": ("process", "manufacturing", "assembly", "soldering", "welding", "installation", "calibration", "coating"),
    "design": ("design", "requirement", "requirements", "spec", "specification", "architecture", "dimensioning", "tolerance"),
    "other": ("system", "subsystem", "overall", "general"),
}
# Right-hand sides of a failure type that say nothing, and words that name an element.
GENERIC_RIGHT = ("general", "specification", "specifications", "approval", "approbation")
ELEMENT_RIGHT = (
    "filter", "switch", "switches", "capacitor", "capacitors", "inductor", "inductors", "sensor", "sensors",
    "connector", "connectors", "isolation", "backcover", "input", "output", "limiter", "protection",
)
ELEMENT_PARTS = (
    "power", "controller", "control", "board", "pcb", "pcba", "interface", "algorithm", "logic", "sensor", "actuator",
    "driver", "converter", "regulator", "transceiver", "communication", "support electronics", "startup", "buck", "cooling",
)
# Parts of words that make a cause a process cause.
PROCESS_PARTS = (
    "assembly", "assemble", "mount", "install", "weld", "solder", "coating", "curing", "operator", "manual", "handling",
    "pack", "packing", "shipment", "torque", "fixture", "alignment",
)
# What a sentence of a type must not hold, and what shows a level of assertion.
DENIED = {
    "symptom": ("temperature", "voltage", "stress"),
    "condition": ("fail", "not working"),
    "occurrence": (),
    "investigation": ("caused by",),
    "root_cause_evidence": ("may", "suspected"),
}
ASSERTION_MARKS = {
    "confirmed": ("confirmed", "verified", "reproduced"),
    "ruled_out": ("ruled out", "excluded", "not the cause", "disregarded", "no evidence", "be not"),
    "suspected": ("suspected", "may", "likely", "possible", "might"),
}
CONJUNCTIONS = (" and ", " or ", " while ", " as well as ", ";")


def _any_part(x: Column, parts: tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(*[F.contains(x, F.lit(p)) for p in parts], F.lit(False)), F.lit(False)) if parts else F.lit(False)


def _words(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit("[a-z0-9]+"), F.lit(0))


def discipline(failure_type: Column) -> Column:
    words = _words(normalize_key(failure_type))
    out = F.lit(None).cast("string")
    for name, known in reversed(DISCIPLINES.items()):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, known))), F.lit(name)).otherwise(out)
    return out


def names_element(failure_type: Column) -> Column:
    return _any_part(normalize_key(failure_type), ELEMENT_PARTS)


def failure_type_parts(failure_type: Column) -> Column:
    """struct(discipline, element) of "left / right": the right side names an element, or the left side a discipline."""
    raw = F.trim(failure_type)
    parts = F.split(raw, "/", 2)
    left, right = normalize_key(parts[0]), normalize_key(F.get(parts, F.lit(1)))
    element = F.concat_ws(" / ", left, right)
    slash = raw.contains("/")
    is_element = F.arrays_overlap(_words(right), F.array(*map(F.lit, ELEMENT_RIGHT))) | _any_part(right, ELEMENT_PARTS)
    generic = right.isin(*GENERIC_RIGHT)
    of_left = discipline(left)
    return F.struct(
        F.when(~slash, discipline(raw)).when(slash & (generic | ~is_element), of_left).alias("discipline"),
        F.when(slash & ~generic & (is_element | of_left.isNull()), element).alias("element"),
    )


def process_hits(cause: Column) -> Column:
    """The process parts that a cause holds, in the order of the list."""
    text = F.lower(F.coalesce(cause, F.lit("")))
    return F.filter(F.array(*map(F.lit, PROCESS_PARTS)), lambda p: F.contains(text, p))


def fmea_level(cause: Column, threshold: int = 1) -> Column:
    return F.when(F.size(process_hits(cause)) >= threshold, F.lit("process")).otherwise(F.lit("non-process"))


def entity_rule(kind: Column, text: Column) -> Column:
    """Does a sentence keep the rule of its type; unknown types don't."""
    t = normalize_spaces(text)
    out = F.lit(False)
    for name, denied in DENIED.items():
        out = F.when(kind == name, ~_any_part(t, denied)).otherwise(out)
    return out


def assertion_rule(level: Column, text: Column) -> Column:
    """Does a sentence show its level of assertion; observed needs no mark. Marks are looked for in plain, not lemmatised, text."""
    t = normalize_spaces(text)
    out = F.coalesce(level == "observed", F.lit(False))
    for name, marks in ASSERTION_MARKS.items():
        out = F.when(level == name, _any_part(t, marks)).otherwise(out)
    return out


def is_atomic(text: Column, commas: int = 1) -> Column:
    t = normalize_spaces(text)
    return ~_any_part(t, CONJUNCTIONS) | (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) <= commas)
