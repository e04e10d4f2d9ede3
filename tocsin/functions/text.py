"""Text parsing as column expressions: positions, message dates, tags, levels, numbers."""
from pyspark.sql import Column, functions as F

POSITION = r"(\d{1,2})-(\d{1,2}(?:\.\d+)?)([NS])\s+(\d{1,3})-(\d{1,2}(?:\.\d+)?)([EW])"
MESSAGE_DATE = r"\d{6}Z (\w{3}) (\d{4})"


def first_position(text) -> Column:
    """struct(lat, lon) of the first DD-MM.mN DDD-MM.mE position in the text; NULL when there is none."""
    def g(i):
        return F.regexp_extract(text, POSITION, i)
    lat = (g(1).try_cast("double") + g(2).try_cast("double") / 60) * F.when(g(3) == "S", -1).otherwise(1)
    lon = (g(4).try_cast("double") + g(5).try_cast("double") / 60) * F.when(g(6) == "W", -1).otherwise(1)
    return F.when(g(1) != "", F.struct(lat.alias("lat"), lon.alias("lon")))


def message_date(text) -> Column:
    """Date of a message stamp such as 071541Z SEP 2023."""
    part = F.regexp_extract(text, r"(\d{2})\d{4}Z (\w{3}) (\d{4})", 0)
    d = F.concat_ws(" ", F.substring(part, 1, 2), F.initcap(F.substring(part, 9, 3)), F.substring(part, 13, 4))
    return F.to_date(F.try_to_timestamp(d, F.lit("dd MMM yyyy")))


def first_tag(text, patterns) -> Column:
    """Name of the first (name, regex) that matches."""
    c = None
    for name, rx in patterns:
        c = F.when(text.rlike(rx), name) if c is None else c.when(text.rlike(rx), name)
    return c


def keep(text, include, exclude) -> Column:
    return text.rlike(include) & ~text.rlike(exclude)


def advisory_level(title) -> Column:
    return F.regexp_extract(title, r"(?i)level\s*([1-4])", 1).try_cast("int")


def last_probability(text) -> Column:
    """Last percentage or fraction stated in a text, as a probability clipped to 0.001..0.999."""
    pct = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    frac = F.regexp_extract_all(text, F.lit(r"\b(0?\.\d+)\b"), F.lit(1))
    p = F.coalesce(F.try_element_at(pct, F.lit(-1)).try_cast("double") / 100, F.try_element_at(frac, F.lit(-1)).try_cast("double"))
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999)))


def normalised_title(t) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " "))


def clean_error(t) -> Column:
    """Error text without addresses, digits runs or surrounding noise."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"https?://\S+", "<url>"), r"\d+", "#"))


def headline_number(x) -> Column:
    """Half-up whole number that never lifts 49.x to 50."""
    r = F.floor(x + 0.5)
    return F.when((r == 50) & (x < 50), 49).otherwise(r).cast("int")


def tag_stripped(html) -> Column:
    no_code = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]+>", " "), r"\s+", " "))
