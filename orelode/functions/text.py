"""Column functions over text: normalising, parsing and formatting. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"^[\s ]+|[\s ]+$"


def strip(c: Column) -> Column:
    """Without white space at both ends, line feeds included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def normalise(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return squeeze(F.lower(c))


def norm(c: Column) -> Column:
    """Lower case and trimmed; null is empty."""
    return F.lower(F.coalesce(strip(c), F.lit("")))


def clean_title(c: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(squeeze(c), r"[.\s]+$", ""), 1, most)


def chunk_id(source: Column, page: Column, number: Column, text: Column) -> Column:
    return F.concat(source, F.lit(":p"), page.cast("string"), F.lit(":c"), number.cast("string"), F.lit(":"), F.substring(F.md5(text), 1, 12))


def int_or(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def context_label(rank: Column, source: Column, item: Column, title: Column, page: Column, text: Column) -> Column:
    section = F.when(F.coalesce(item, F.lit(0)) > 0, F.concat(F.lit("Item "), item.cast("string"), F.lit(" ("), F.coalesce(title, F.lit("")), F.lit(")"))).otherwise("section unknown")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), source, F.lit(" "), section, F.lit(" page "), page.cast("string"), F.lit("\n"), text)


def item_list(c: Column, most: int = 27) -> Column:
    """Numbers 1 to `most` among the parts between commas, semicolons and spaces; order and repeats stay."""
    numbers = F.transform(F.split(c, r"[,;\s]+"), lambda x: F.when(F.rlike(x, F.lit(r"^\d+$")), x.try_cast("int")))
    return F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= most))


def truncated(c: Column, most: int, marker: str) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def hole_id(c: Column) -> Column:
    return F.upper(strip(c))


def canonical_hole_id(c: Column) -> Column:
    """Letters and numbers without separators, numbers without leading zeros."""
    tokens = F.regexp_extract_all(hole_id(c), F.lit(r"\d+|[A-Z]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit(r"^\d")), F.regexp_replace(t, r"^0+(?=\d)", "")).otherwise(t)), "")


def keywords(question: Column, stop: list[str], shortest: int = 3) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9][a-z0-9_-]*"), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(words), lambda w: F.length(w) >= shortest), F.array(*(F.lit(w) for w in stop)))


def overlap(text: Column, words: Column) -> Column:
    """How many of the words the text contains, within words too."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: F.contains(low, w)))


# What a short greeting or thanks consists of, but for marks after it, and how long it can be.
GREETINGS, GREETING_MARKS, GREETING_LENGTH = ["hi", "hello", "hey", "thanks", "thank you", "bye", "goodbye", "ok", "okay"], "!.?", 50


def is_greeting(c: Column) -> Column:
    """A short greeting or thanks and nothing else; null is none."""
    whole = strip(F.lower(c))
    bare = F.regexp_replace(whole, rf"[\s{GREETING_MARKS}]+$", "")
    return F.coalesce((F.length(whole) <= GREETING_LENGTH) & bare.isin(GREETINGS), F.lit(False))


def _fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def tonnes_text(v: Column) -> Column:
    return (F.when(v.isNull(), "—").when(v >= 1e9, F.concat(_fixed(v / 1e9, 3), F.lit(" Bt"))).when(v >= 1e6, F.concat(_fixed(v / 1e6, 3), F.lit(" Mt")))
            .when(v >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit(" kt"))).otherwise(F.concat(_fixed(v, 0), F.lit(" t"))))


def short_tonnes_text(v: Column) -> Column:
    """As tonnes_text(), in megatonnes with two places at most."""
    return (F.when(v.isNull(), "—").when(v >= 1e6, F.concat(_fixed(v / 1e6, 2), F.lit(" Mt"))).when(v >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit(" kt")))
            .otherwise(F.concat(_fixed(v, 0), F.lit(" t"))))


def _unit(unit: Column) -> Column:
    return F.when(F.coalesce(unit, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), unit))


def grade_text(v: Column, unit: Column) -> Column:
    return F.when(v.isNull(), "—").otherwise(F.concat(_fixed(v, 2), _unit(unit)))


def amount_text(v: Column, unit: Column) -> Column:
    tail = _unit(unit)
    return F.when(v.isNull(), "—").otherwise(F.concat(F.when(v >= 1e6, F.concat(_fixed(v / 1e6, 3), F.lit("M"))).when(v >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit("K"))).otherwise(_fixed(v, 0)), tail))


# Keywords that resource categories are told by, in order; the last is the default.
CATEGORIES = ["measured", "indicated", "inferred", "proven", "probable"]


def category_class(c: Column, order: list[str] = CATEGORIES, default: str = "inferred") -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), k) for k in order), F.lit(default))


# Names of countries, and what they are written as.
COUNTRIES = {"usa": "United States", "us": "United States", "u.s.": "United States", "u.s.a.": "United States", "united states of america": "United States", "drc": "DRC", "uk": "United Kingdom", "united kingdom": "United Kingdom"}


def country(c: Column) -> Column:
    low = F.lower(strip(c))
    known = F.coalesce(*(F.when(low == k, v) for k, v in COUNTRIES.items()))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(F.when(F.contains(low, F.lit("democratic republic of congo")), "DRC"), known, strip(c)))


# What commodities begin with, in order, and what they are written as.
COMMODITIES = {"au": "Gold", "gold": "Gold", "cu": "Copper", "copper": "Copper", "ag": "Silver", "silver": "Silver", "li": "Lithium", "lithium": "Lithium", "ni": "Nickel", "nickel": "Nickel", "zn": "Zinc", "zinc": "Zinc",
               "pb": "Lead", "lead": "Lead", "fe": "Iron", "iron": "Iron", "co": "Cobalt", "cobalt": "Cobalt", "mo": "Molybdenum", "molybdenum": "Molybdenum", "u": "Uranium", "uranium": "Uranium", "u3o8": "Uranium"}


def commodity(c: Column) -> Column:
    """By the first key that the name begins with, so that names which merely begin alike are taken too."""
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(*(F.when(F.startswith(bare, F.lit(k)), v) for k, v in COMMODITIES.items()), strip(c)))


# Labels of project stages.
STAGES = {"operating": "Operating", "construction": "Construction", "feasibility": "Feasibility", "prefeasibility": "Pre-Feasibility", "pea": "PEA", "care": "Care & Maintenance", "exploration": "Exploration"}
# In order, a stage and the parts of a text that tell it; a text with one of the last parts isn't of that stage.
STAGE_PARTS = [("operating", ["operating", "produc"], []), ("construction", ["construction"], []), ("feasibility", ["feasibility"], ["pre"]), ("prefeasibility", ["pre-feasib", "prefeasib"], []),
               ("pea", ["pea", "preliminary econ"], []), ("care", ["care", "maintenance"], []), ("exploration", ["exploration", "grassroots", "resource def"], [])]


def has_any(c: Column, parts: list[str]) -> Column:
    """Whether the text contains one of the parts."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in parts), F.lit(False))


def stage_key(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(has_any(low, some) & ~has_any(low, none), key) for key, some, none in STAGE_PARTS), F.lit("default"))


def stage(c: Column) -> Column:
    key = stage_key(c)
    return F.coalesce(*(F.when(key == k, v) for k, v in STAGES.items()), F.lit("Other"))


# In order, a currency and the parts of an amount that tell it; the last currency is that of all others.
CURRENCIES, OTHER_CURRENCY = {"CAD": ["c$", "cad", "canadian"], "AUD": ["a$", "aud", "australian"], "EUR": ["eur", "€", "euro"]}, "USD"
# Words that make an amount one of thousands of millions, or of thousandths; and those that forbid each.
BILLION, THOUSAND, NOT_BILLION, NOT_THOUSAND = r"\b(billion|bn)\b|[\d.]+\s*b\b", r"\b(thousand|k)\b", ["million", "mln"], ["million", "billion"]


def money(c: Column) -> Column:
    """struct(value in millions, currency); US dollars unless another currency is named; no conversion."""
    low = F.lower(strip(c))
    currency = F.coalesce(*(F.when(has_any(low, parts), k) for k, parts in CURRENCIES.items()), F.lit(OTHER_CURRENCY))
    number = F.regexp_extract(F.replace(low, F.lit(","), F.lit("")), r"\d+(\.\d+)?", 0).try_cast("double")
    power = F.when(F.rlike(low, F.lit(BILLION)) & ~has_any(low, NOT_BILLION), 1000.0).when(F.rlike(low, F.lit(THOUSAND)) & ~has_any(low, NOT_THOUSAND), 0.001).otherwise(1.0)
    value = F.when(power < 1, number / 1000).otherwise(number * power)
    known = F.coalesce(c, F.lit("")) != ""
    return F.struct(F.when(known, value).alias("value"), F.when(known, currency).alias("currency"))


def percent(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([\d.]+)", 1), F.lit("")).try_cast("double")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def marker_radius(tonnes: Column) -> Column:
    return F.when(tonnes > 0, F.greatest(F.lit(6.0), F.least(F.lit(30.0), 6 + F.sqrt(tonnes / 1e6) * 2.5))).otherwise(8.0)


def or_dash(c: Column, default: str = "—") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


# Parts of a question that ask for a decision.
DECISION_PARTS = ["go", "no-go", "no go", "invest", "decision", "should the project be classified"]


def assessment(question: Column, answer: Column, flags: Column) -> Column:
    """Null unless the question asks for a decision; then what the answer says, or else by the number of flags."""
    says = lambda pattern: F.rlike(F.lower(answer), F.lit(pattern))
    told = (F.when(says(r"\bno-?go\b"), "No-Go").when(says(r"conditional\s+go"), "Conditional Go").when(says(r"\bfurther\s+work\b"), "Further Work")
            .when(says(r"\bgo\b") & ~says("no-?go"), "Go"))
    by_flags = F.when(flags >= 4, "No-Go").when(flags >= 2, "Conditional Go").when(flags >= 1, "Further Work").otherwise("Go")
    return F.when(has_any(F.lower(question), DECISION_PARTS), F.coalesce(told, by_flags))


def with_assessment(answer: Column, found: Column) -> Column:
    """The answer with its assessment at the end, unless it names one."""
    return F.when(found.isNotNull() & ~F.contains(answer, F.lit("Assessment:")), F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit("\n\n**Assessment:** "), found)).otherwise(answer)


def assessment_class(c: Column) -> Column:
    low = F.lower(c)
    return (F.when(F.coalesce(c, F.lit("")) == "", "").when(has_any(low, ["no-go", "no go"]), "nogo").when(F.contains(low, F.lit("conditional")), "conditional")
            .when(F.contains(low, F.lit("further")), "further").otherwise("go"))


# In order, parts of a commodity's name and the colour of its marks; and that of all others.
COLOURS = {
    "au": "#F59E0B", "gold": "#F59E0B", "cu": "#C2410C", "copper": "#C2410C", "ag": "#9CA3AF", "silver": "#9CA3AF", "li": "#3B82F6", "lithium": "#3B82F6", "ni": "#10B981", "nickel": "#10B981",
    "zn": "#8B5CF6", "zinc": "#8B5CF6", "pb": "#6B7280", "lead": "#6B7280", "fe": "#EF4444", "iron": "#EF4444", "co": "#06B6D4", "cobalt": "#06B6D4", "mo": "#F97316", "molybdenum": "#F97316", "u3o8": "#84CC16", "uranium": "#84CC16",
}
OTHER_COLOUR = "#9CA3AF"


def commodity_colour(c: Column, colours: dict[str, str] = COLOURS, other: str = OTHER_COLOUR) -> Column:
    """The colour of the first part that the bare name contains."""
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.coalesce(*(F.when(F.contains(bare, F.lit(k)), v) for k, v in colours.items()), F.lit(other))


def primary_grade(grades: Column, flat: Column | None = None) -> Column:
    """The first of an estimate's grades, or `flat`, a struct of the same fields, where it has none."""
    first = F.get(grades, F.lit(0))
    return first if flat is None else F.when(F.size(F.coalesce(grades, F.array())) > 0, first).otherwise(flat)


def grades_text(grades: Column) -> Column:
    """All grades with a value, each with its commodity, between bullets."""
    one = lambda g: F.concat(F.when(F.coalesce(g["commodity"], F.lit("")) == "", "").otherwise(F.concat(g["commodity"], F.lit(": "))), grade_text(g["grade_value"], g["grade_unit"]))
    joined = F.array_join(F.transform(F.filter(grades, lambda g: g["grade_value"].isNotNull()), one), " • ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("—"))


def joined_content(blocks: Column) -> Column:
    """The text of an answer that comes as a list of struct(text, content): of each block the first that isn't blank."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), b["content"], F.lit(""))), "")


def history_text(pairs: Column, most: int = 10) -> Column:
    """The last `most` of an array of struct(question, answer) as a dialog; an empty one is "None"."""
    last = F.slice(pairs, F.greatest(F.lit(1), F.size(pairs) - (most - 1)), most)
    told = F.array_join(F.transform(last, lambda p: F.concat(F.lit("User: "), p["question"], F.lit("\nAssistant: "), p["answer"])), "\n\n")
    return F.coalesce(F.nullif(told, F.lit("")), F.lit("None"))


def chat_prompt(instruction: Column, context: Column, question: Column, history: Column | None = None) -> Column:
    """The prompt of an answering model: a line of instruction and the parts as JSON."""
    parts = [instruction.alias("instruction"), context.alias("context"), question.alias("question")]
    return F.concat(F.lit("Follow the instruction and answer clearly.\n\n"), F.to_json(F.struct(*parts, *([] if history is None else [history.alias("history")])), {"pretty": "true"}))


def answer_event(kind: str, **fields: Column) -> Column:
    """One server-sent event with its type and fields as JSON."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in fields.items()))), F.lit("\n\n"))
