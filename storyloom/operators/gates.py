"""Gates that decide which items of feeds are kept, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import has_word
from storyloom.operators import dictionary


@dataclass(frozen=True)
class Gates:
    """The patterns of one domain. ``alone`` is a word that counts only beside ``corroboration``."""

    blacklist: str
    ceremonial: str
    action: str
    keywords: str
    alone: str
    corroboration: str
    social: tuple = ("social",)
    passing: tuple = ("official", "specialized")


def item_text(title: str = "title", snippet: str = "snippet") -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))


def gated(items: DataFrame, key: str, gates: Gates, names: DataFrame, feed_tier: str = "feed_tier", tier: str = "tier") -> DataFrame:
    """(key, gate, relevant) of each item (key, title, snippet, tiers of its feed and its own).

    The first gate that decides is named: ``blacklist`` (no); for social items ``ceremonial`` (no), ``action`` (yes), ``social_entity`` (yes), ``no_action`` (no); for the others ``entity``, ``keyword``, ``corroborated``, ``tier`` (yes) and
    ``nothing`` (no). Entities are ``names`` (position, pattern), a dictionary of any size, which only items are looked up in that earlier gates let through. Null titles and snippets are empty.
    """
    text = items.select(key, item_text().alias("_text"), F.coalesce(F.col(feed_tier).isin(*gates.social) | F.col(tier).isin(*gates.social), F.lit(False)).alias("_social"), F.coalesce(F.col(feed_tier).isin(*gates.passing) | F.col(tier).isin(*gates.passing), F.lit(False)).alias("_passes"))
    has = lambda pattern: has_word(F.col("_text"), pattern)
    early = F.when(has(gates.blacklist), "blacklist").when(F.col("_social") & has(gates.ceremonial), "ceremonial").when(F.col("_social") & has(gates.action), "action")
    first = text.withColumn("_early", early)
    named = dictionary.found_patterns(first.where("_early IS NULL").select(key, "_text"), key, "_text", names).select(key).distinct().withColumn("_named", F.lit(True))
    rest = F.when(F.col("_social") & F.col("_named"), "social_entity").when(F.col("_social"), "no_action").when(F.col("_named"), "entity").when(has(gates.keywords), "keyword")
    rest = rest.when(has(gates.alone) & has(gates.corroboration), "corroborated").when(F.col("_passes"), "tier").otherwise("nothing")
    gate = F.coalesce("_early", rest)
    found = first.join(named, key, "left").withColumn("gate", gate)
    return found.select(key, "gate", (~F.col("gate").isin("blacklist", "ceremonial", "no_action", "nothing")).alias("relevant"))


# Tags of the domain by how they begin, and acronyms that a number and a letter may follow.
STRATEGIC_TAGS = (
    "atmanirbhar|idex|makeinindia|iddm|procurement|strategic|indigenous|dap2020|drdo|hal|bel|tasl|mod|dac|ccs|lac|loc|army|navy|airforce|iaf|c-?uas|cuas|uav|ucav|bmd|ew|sigint|radar|sonar|artillery|missile|warship|"
    "submarine|corvette|frigate|destroyer|aircraft|fighter|stealth|hypersonic|aeroindia|defexpo|defense|defence|aviation|aerospace|apache"
)
ACRONYM_TAGS = "tasl|lac|loc|drdo|hal|iaf|mod|dac|ccs|amca|qrsam|bmd|uav|ucav|eos|ins|bvr|mbrl|atgm|lracm|erads|mig|su|csl|mdl|grse|gsl|bel|bdl|midhani"


def domain_tags(tags: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """(column, in_domain) of the distinct tags: no noise, and an acronym, a strategic beginning, or a name of the dictionary ``names`` (position, pattern) in it."""
    from storyloom.functions import cleaning

    each = tags.select(column).distinct()
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), "^#+", ""), "(?i)^th[_-]", ""))
    low = F.regexp_replace(F.lower(clean), r"[\s\-_]+", "")
    sure = low.rlike(rf"^(?:{ACRONYM_TAGS})\d*[a-z]?$") | low.rlike(rf"^(?:{STRATEGIC_TAGS})")
    each = each.select(column, clean.alias("_clean"), (~cleaning.is_noise_tag(F.col(column)) & (F.length(clean) > 1)).alias("_may"), sure.alias("_sure"))
    named = dictionary.found_patterns(each.where("_may AND NOT _sure").select(column, "_clean"), column, "_clean", names).select(column).distinct().withColumn("_named", F.lit(True))
    return each.join(named, column, "left").select(column, (F.col("_may") & (F.col("_sure") | F.coalesce("_named", F.lit(False)))).alias("in_domain"))
