"""Scans of feed documents: RSS and Atom items, JSON question lists, social posts, files up to a size. Feeds are rows with their text in one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import cleaning

MOST_BYTES = 5 << 20


def capped_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, content) of the files of ``path`` that hold at most ``most`` bytes; content is null for larger ones, which are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= most).select("path", "length", "content")
    return small.union(files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary")))


def tag_value(block: Column, tag: str, low: Column | None = None) -> Column:
    """What the first element ``tag`` of an XML block holds, without CDATA marks; empty if there is none. ``low`` is the block in small letters, by which blocks without the tag are found out sooner."""
    found = F.trim(F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1))
    return found if low is None else F.when(low.contains(f"<{tag.lower()}"), found).otherwise("")


def attribute(block: Column, tag: str, name: str, test: str = "", low: Column | None = None) -> Column:
    """The attribute ``name`` of the first element ``tag`` that also has ``test`` in it; empty if there is none."""
    found = cleaning.named_entities(F.regexp_extract(block, rf"(?i)<{tag}\b(?=[^>]*{test})[^>]*?\b{name}=[\"']([^\"']+)[\"']", 1))
    return found if low is None else F.when(low.contains(f"<{tag.lower()}"), found).otherwise("")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty. Each is worked out once, and only if those before are not filled."""
    return F.coalesce(*[cleaning.bound(v, lambda x: F.when(x != "", x)) for v in values], F.lit(""))


def web(url: Column) -> Column:
    return cleaning.bound(url, lambda u: F.when(u.rlike("(?i)^https?://[^/]"), u).otherwise(""))


def published(text: Column, otherwise: Column) -> Column:
    """The time of an item's date, in ISO or mail form; ``otherwise`` for what is neither."""
    mail = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)$", " +0000")
    return F.coalesce(cleaning.bound(F.trim(text), lambda t: F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(mail(t), F.lit("d MMM yyyy HH:mm:ss Z")))), otherwise)


def feed_items(feeds: DataFrame, column: str, now: Column, most: int = MOST_BYTES) -> DataFrame:
    """Items of RSS and Atom texts: the other columns, then title, url, published, body, thumbnail and tags.

    A text is Atom if it has ``<feed`` or ``<entry``. Items without a title or an address of the web go, texts of more than ``most`` bytes as well. An unknown
    date is ``now``. The address is the link's href, else its text, else a guid that is one; bodies are taken from description, media:description, summary,
    content:encoded and content in this order. Tags are categories and inline hashtags, each once in any case.
    """
    rest = [c for c in feeds.columns if c != column]
    atom = F.col(column).rlike("(?i)<(feed|entry)[\\s>]")
    blocks = F.when(atom, F.regexp_extract_all(column, F.lit("(?is)<entry[\\s>].*?</entry>"), F.lit(0))).otherwise(F.regexp_extract_all(column, F.lit("(?is)<item[\\s>].*?</item>"), F.lit(0)))
    items = feeds.where(F.octet_length(column) <= most).select(*rest, F.explode(blocks).alias("_block"))

    def item(x: Column) -> Column:
        b, low = x["b"], x["low"]
        value, attr = (lambda tag: tag_value(b, tag, low)), (lambda tag, name, test="": attribute(b, tag, name, test, low))
        url = first_filled(attr("link", "href"), value("link"), web(value("guid")))
        image = first_filled(web(attr("media:thumbnail", "url")), web(attr("media:content", "url", "(?:type=[\"']image/|medium=[\"']image[\"'])")), web(attr("enclosure", "url", "type=[\"']image/")))
        tags = F.regexp_extract_all(b, F.lit("(?is)<(?:category|dc:subject)\\b[^>]*>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</(?:category|dc:subject)>"), F.lit(1))
        return F.struct(
            cleaning.plain_text(cleaning.named_entities(value("title"))).alias("title"),
            web(cleaning.named_entities(url)).alias("url"),
            published(first_filled(*[value(t) for t in ("pubDate", "published", "updated", "dc:date")]), now).alias("published"),
            cleaning.plain_text(cleaning.named_entities(first_filled(*[value(t) for t in ("description", "media:description", "summary", "content:encoded", "content")]))).alias("body"),
            image.alias("thumbnail"),
            F.transform(tags, lambda s: F.trim(s)).alias("_tags"),
        )

    # an item is an array that is taken out of itself, so that no filter or later column works its fields out anew
    once = F.filter(F.transform(F.array(F.struct(F.col("_block").alias("b"), F.lower("_block").alias("low"))), item), lambda x: (x["title"] != "") & (x["url"] != ""))
    found = items.select(*rest, F.explode(once).alias("_item")).select(*rest, "_item.*")
    inline = F.regexp_extract_all(F.concat(F.lit(" "), "title", F.lit(" "), "body"), F.lit(r"\s#([a-zA-Z0-9][a-zA-Z0-9_\-]{1,49})"), F.lit(1))
    tags = F.filter(F.transform(F.concat("_tags", inline), cleaning.clean_tag), lambda t: ~cleaning.is_noise_tag(t))
    return found.withColumn("tags", first_of_case(tags)).drop("_tags")


def first_of_case(words: Column) -> Column:
    """Each word once, whatever its case: the first one stays."""
    return F.aggregate(words, F.array().cast("array<string>"), lambda done, w: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(w)), done).otherwise(F.concat(done, F.array(w))))


# --- parliamentary questions

QUESTION = "struct<house:string,questionNo:string,type:string,date:string,ministry:string,minister:string,member:string,subject:string,answer:string,pdfUrl:string,url:string>"


def questions(payloads: DataFrame, column: str) -> DataFrame:
    """Raw questions of JSON payloads: a list, or an object with the list in ``data``, ``items`` or ``questions``. Payloads that do not parse have none."""
    rest = [c for c in payloads.columns if c != column]
    as_list = F.from_json(column, f"array<{QUESTION}>")
    as_object = F.from_json(column, f"struct<data:array<{QUESTION}>,items:array<{QUESTION}>,questions:array<{QUESTION}>>")
    found = F.when(F.trim(column).startswith("["), as_list).otherwise(F.coalesce(as_object["data"], as_object["items"], as_object["questions"]))
    return payloads.select(*rest, F.explode(found).alias("q")).select(*rest, "q.*")


def question_day(text: Column, otherwise: Column) -> Column:
    """A day as yyyy-MM-dd, of d/m/yyyy (also with dots or hyphens), of an ISO date, else ``otherwise``."""
    t = F.trim(F.coalesce(text, F.lit("")))
    dmy = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    day = F.concat_ws("-", F.regexp_extract(t, dmy, 3), F.lpad(F.regexp_extract(t, dmy, 2), 2, "0"), F.lpad(F.regexp_extract(t, dmy, 1), 2, "0"))
    return F.when(t.rlike(dmy), day).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)).otherwise(F.coalesce(F.date_format(published(t, F.lit(None).cast("timestamp")), "yyyy-MM-dd"), otherwise))


def question_number(raw: Column, kind: Column) -> Column:
    """``USQ n`` or ``SQ n``: by the number's own prefix, else by ``kind``."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    own = F.when(kind == "Starred", "SQ").otherwise("USQ")
    n = F.regexp_extract(t, r"\b(\d+)\b", 1)
    return (
        F.when(t.rlike(r"(?i)^(USQ|AU|Unstarred)\s*\d+$"), F.concat(F.lit("USQ "), F.regexp_extract(t, r"(\d+)$", 1)))
        .when(t.rlike(r"(?i)^(SQ|AS|Starred)\s*\d+$"), F.concat(F.lit("SQ "), F.regexp_extract(t, r"(\d+)$", 1)))
        .when(n != "", F.concat_ws(" ", own, n)).when(t != "", t).otherwise(F.concat(own, F.lit(" 0")))
    )


def normalized_questions(raw: DataFrame, today: Column, default_house: str = "Lok Sabha") -> DataFrame:
    """Adds question_number, question_type, answering_date, full_house, full_ministry and title to raw questions."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    ministry = cleaning.plain_text(F.coalesce("ministry", F.lit("")))
    found = raw.withColumns({
        "full_house": F.when(F.contains(F.lower(F.coalesce("house", F.lit(""))), F.lit("rajya")), "Rajya Sabha").otherwise(default_house),
        "question_type": F.when(F.contains(kind, F.lit("starred")) & ~F.contains(kind, F.lit("unstarred")), "Starred").otherwise("Unstarred"),
        "answering_date": question_day(F.col("date"), today),
        "full_ministry": F.when((ministry == "") | ministry.rlike("(?i)^(defence|mod)$"), "Ministry of Defence").when(ministry.startswith("Ministry of"), ministry).otherwise(F.concat(F.lit("Ministry of "), ministry)),
    })
    found = found.withColumn("question_number", question_number(F.col("questionNo"), F.col("question_type")))
    subject = F.coalesce(F.nullif(cleaning.plain_text("subject"), F.lit("")), F.lit("Parliamentary Defence Question"))
    title = F.concat("full_house", F.lit(" "), "question_type", F.lit(" Question No. "), F.regexp_replace("question_number", r"^[A-Z]+\s*", ""), F.lit(": "), subject)
    return found.withColumn("title", title)


# --- social posts


def without_trackers(text: Column) -> Column:
    # Hosts of shortened addresses.
    short = r"(?i)https?://(?:t\.co|bit\.ly|tinyurl\.com|ow\.ly|buff\.ly)/[a-zA-Z0-9_-]+"
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), short, ""), r"\s{2,}", " "))


def post_headline(text: Column, most: int = 140) -> Column:
    """A post's text as a headline: no short links, author before, hashtags after; one sentence or whole words if it is too long."""
    # Authors that posts begin with.
    author = r"(?i)^(?:(?:ADG\s+PI|IAF|Indian\s+Navy|DRDO|MoD|PRO\s+Def|Spokesperson)[^:]*:\s*|X\s*/\s*\w+:\s*|@\w+\s*:\s*)"
    clean = F.trim(F.regexp_replace(without_trackers(cleaning.decode_entities(text)), author, ""))
    clean = cleaning.plain_text(F.trim(F.regexp_replace(clean, r"(?:\s*#[a-zA-Z0-9_]+)+\s*$", "")))

    def short(c: Column) -> Column:
        sentence = F.regexp_extract(c, r"^([^.!?]+[.!?])", 1)
        piece = F.substring(c, 1, most)
        words = F.regexp_replace(piece, r"(?s) [^ ]*$", "")
        return (
            F.when(F.length(c) <= most, c).when(F.length(sentence).between(30, most), F.trim(sentence))
            .when((F.length(words) > 30) & piece.contains(" "), F.concat(words, F.lit("..."))).otherwise(F.concat(piece, F.lit("...")))
        )

    return cleaning.bound(clean, short)


def handle(text: Column) -> Column:
    """The account in an address of a social site, else the first one that a text names; null if there is none."""
    by_url = F.regexp_extract(text, r"(?i)(?:x\.com|twitter\.com|nitter\.[a-z]+)/([a-zA-Z0-9_]{1,25})", 1)
    by_name = F.regexp_extract(text, r"@([a-zA-Z0-9_]{1,25})", 1)
    found = first_filled(by_url, by_name)
    return F.when(found != "", F.concat(F.lit("@"), found))


def status_url(url: Column, account: Column) -> Column:
    """The address of a post at its own site, from that of a mirror; other addresses stay as they are."""
    status = first_filled(F.regexp_extract(url, r"(?i)status(?:es)?/([0-9]+)", 1), F.regexp_extract(url, r"#([0-9]{10,})", 1))
    return F.when((status != "") & account.isNotNull(), F.concat(F.lit("https://x.com/"), F.regexp_replace(account, "^@", ""), F.lit("/status/"), status)).otherwise(url)
