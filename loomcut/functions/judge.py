"""Reading what model judges write: numbers, JSON, ranks and score trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The checklist as rows of first level, third level, and the second level that the third belongs to.
LEVELS = [
    ("Quality", "Physical Logic", "Realism"),
    ("Quality", "Material Texture", "Realism"),
    ("Quality", "Noise", "Detail"),
    ("Quality", "Edge Clarity", "Detail"),
    ("Quality", "Naturalness", "Detail"),
    ("Quality", "Resolution", "Resolution"),
    ("Aesthetics", "Composition", "Composition"),
    ("Aesthetics", "Color Harmony", "Color Harmony"),
    ("Aesthetics", "Lighting & Atmosphere", "Lighting"),
    ("Aesthetics", "Anatomical Fidelity", "Anatomical Portraiture"),
    ("Aesthetics", "Emotional Expression", "Emotional Expression"),
    ("Aesthetics", "Style Control", "Style Control"),
    ("Alignment", "Quantity", "Attributes"),
    ("Alignment", "Facial Expression", "Attributes"),
    ("Alignment", "Material Properties", "Attributes"),
    ("Alignment", "Color", "Attributes"),
    ("Alignment", "Shape", "Attributes"),
    ("Alignment", "Size", "Attributes"),
    ("Alignment", "Contact Interaction", "Actions"),
    ("Alignment", "Non-contact Interaction", "Actions"),
    ("Alignment", "Full-body Action", "Actions"),
    ("Alignment", "2D Space", "Layout"),
    ("Alignment", "3D Space", "Layout"),
    ("Alignment", "Composition Relationship", "Relations"),
    ("Alignment", "Difference/Similarity", "Relations"),
    ("Alignment", "Containment", "Relations"),
    ("Alignment", "Real-world Scene", "Scene"),
    ("Alignment", "Virtual Scene", "Scene"),
    ("Real-world Fidelity", "Social Bias", "Fairness"),
    ("Real-world Fidelity", "Cultural Fairness", "Fairness"),
    ("Real-world Fidelity", "Safety & Compliance", "Safety & Compliance"),
    ("Real-world Fidelity", "Animals", "World Knowledge"),
    ("Real-world Fidelity", "Objects", "World Knowledge"),
    ("Real-world Fidelity", "Information Visualization", "World Knowledge"),
    ("Real-world Fidelity", "Temporal Characteristics", "World Knowledge"),
    ("Real-world Fidelity", "Cultural Elements", "World Knowledge"),
    ("Creative Generation", "Imagination", "Imagination"),
    ("Creative Generation", "Feature Matching", "Feature Matching"),
    ("Creative Generation", "Logical Resolution", "Logical Resolution"),
    ("Creative Generation", "Text Accuracy", "Text Rendering"),
    ("Creative Generation", "Text Layout", "Text Rendering"),
    ("Creative Generation", "Font", "Text Rendering"),
    ("Creative Generation", "Cross-lingual Generation", "Text Rendering"),
    ("Creative Generation", "Graphic Design", "Design Applications"),
    ("Creative Generation", "Product Design", "Design Applications"),
    ("Creative Generation", "Spatial Design", "Design Applications"),
    ("Creative Generation", "Fashion Styling", "Design Applications"),
    ("Creative Generation", "Game Design", "Design Applications"),
    ("Creative Generation", "Art Design", "Design Applications"),
    ("Creative Generation", "Cinematic Style", "Visual Storytelling"),
    ("Creative Generation", "Camera / Lens Style", "Visual Storytelling"),
    ("Creative Generation", "Storyboard Creation", "Visual Storytelling"),
    ("Creative Generation", "Shot Sizes", "Visual Storytelling"),
    ("Creative Generation", "Composition", "Visual Storytelling"),
    ("Creative Generation", "Angles", "Visual Storytelling"),
    ("Creative Generation", "Comic Creation", "Visual Storytelling"),
]
RENAMED = {("Creative Generation", "Feature Mapping"): "Feature Matching"}
SCORES = {0: 0.0, 1: 60.0, 2: 100.0}


def labelled_number(x: Column, label: str) -> Column:
    """The number after `label (1-5):`, marks of emphasis ignored, the colon ASCII or full-width; null where there is none."""
    plain = F.replace(x, F.lit("*"), F.lit(""))
    return F.regexp_extract(plain, f"(?i){label}\\s*\\(1-5\\)\\s*[:：]\\s*([-+]?[0-9]*\\.?[0-9]+)", 1).try_cast("double")


def first_number(x: Column) -> Column:
    return F.regexp_extract(x, r"[-+]?\d*\.?\d+", 0).try_cast("double")


def json_text(x: Column) -> Column:
    """The JSON of a judge's answer as text: what follows the last </think>, whole or else from its first { to its last }; null where neither is JSON."""
    rest = F.trim(F.substring_index(x, "</think>", -1))
    inner = F.regexp_extract(rest, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(rest).isNotNull(), rest).when(F.try_parse_json(inner).isNotNull(), inner)


def repaired_json(x: Column) -> Column:
    """json_text(), where that fails with single quotes taken for double ones."""
    return F.coalesce(json_text(x), json_text(F.replace(x, F.lit("'"), F.lit('"'))))


def score_list(x: Column) -> Column:
    """The numbers of `score: [a, b]`, quoted or not; null where there are none."""
    inside = F.regexp_extract(x, r"(?i)[\"']?score[\"']?\s*[:=]\s*\[([^\]]*)\]", 1)
    numbers = F.transform(F.regexp_extract_all(inside, F.lit(r"([-+]?\d*\.?\d+)"), F.lit(1)), lambda n: n.cast("double"))
    return F.when(F.size(numbers) > 0, numbers)


def pointwise(x: Column) -> Column:
    """Mean of the first two numbers of the score list."""
    s = score_list(x)
    return F.when(F.size(s) >= 2, (F.element_at(s, 1) + F.element_at(s, 2)) / 2)


def rank(x: Column) -> Column:
    """0 for a tie, 1 or 2 for the image that is called better within 24 characters; null where none is."""
    low = F.lower(x)
    near = lambda i: low.rlike(f"(?s)image {i}.{{0,24}}(better|best|win|prefer)|(better|best|win|prefer).{{0,24}}image {i}")
    return F.when(low.rlike(r"\b(tie|equal|same)\b"), 0).when(near(1), 1).when(near(2), 2).when(F.trim(low).isin("0", "1", "2"), F.trim(low).try_cast("int"))


def score_value(x: Column) -> Column:
    """0, 60 or 100 of 0, 1 or 2, numbers cut to whole ones; all else null."""
    n = x.cast("string").try_cast("double").cast("int")
    out = F.lit(None).cast("double")
    for k, v in SCORES.items():
        out = F.when(n == k, v).otherwise(out)
    return out


def dims(x: Column) -> Column:
    """Entries of `A / B / C; ...` as array<struct<l1, l2, l3>>; two levels stand for l2 = l3."""
    parts = F.filter(F.transform(F.split(x, ";"), lambda p: F.trim(p)), lambda p: p != "")
    split = F.transform(parts, lambda p: F.transform(F.split(p, r"/"), lambda q: F.trim(q)))
    return F.transform(split, lambda a: F.struct(F.element_at(a, 1).alias("l1"), F.try_element_at(a, F.lit(2)).alias("l2"), F.coalesce(F.try_element_at(a, F.lit(3)), F.try_element_at(a, F.lit(2))).alias("l3")))
