"""Extraction jobs: raw landed pages -> event, basket, profile, holding and set-statistic rows.

The pages have a fixed markup, so every field is a Column expression: pages are split at the opening tags that begin an
event, a card or a row, and fields are read by patterns from the pieces. Nothing leaves the JVM, and a page or field
that doesn't look as expected gives nulls instead of ending the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import clean_number, content_hash, duration_seconds

# Class names and texts of the landed pages.
CLS_EVENT = "battle"
CLS_MODE = "game_mode_header"
CLS_RIBBON = "win_loss"
TXT_WIN = "Victory"
CLS_RESULT = "result_header"
CLS_CHANGE = "trophy_container"
CLS_CHANGE_LABEL = ("ui", "basic", "label")
CLS_SIDE = "team-segment"
CLS_NAME_LINK = "player_name_header"
TXT_NAME_PATH = "/player/"
TXT_LEAK = "Elixir Leaked"
CLS_LEVEL_DIFF = "battle_level_diff"
TXT_LEVEL_DIFF = "Δ Lvl:"
CLS_ITEM_BOX = "deck_card__four_wide"
CLS_ITEM = "deck_card"
CLS_ITEM_LEVEL = "card-level"
CLS_SPECIAL_BOX = "deck_tower_card__container"
TXT_LEVEL = "Lvl"
TXT_EVOLVED = "-ev"
TXT_HERO = "-hero"
CLS_HEAD = "p_head_item"
CLS_RATING_BLOCK = "league_info_container"
CLS_RATING_ICON = ("item_icon", "trophy")
TXT_SEASON = "Current Season"
CLS_CLAN_BLOCK = "player_aux_info"
CLS_CLAN = ("ui", "header", "item")
CLS_HOLDING = ("player_card_link", "player_card_item")
CLS_HOLDING_LEVEL = "player_cards__card_level"
CLS_SPECIAL_HOLDINGS = "player_profile__tower_card_collection"
CLS_EVOLUTION_HOLDINGS = "player_profile__evo_card_collection"
CLS_HOLDINGS = "player_profile__"
CLS_MINI = ("player_card", "mini_card")
CLS_MISSING = "not_found"
CLS_SET = "deck_segment"
TXT_SET_ROW = "Player"
SPECIAL_LEVEL = 16
PROFILE_LABELS = {
    "account age": "account_age", "games per day": "games_per_day", "total": "time_spent", "wins": "wins",
    "losses": "losses", "total games": "total_games", "three crown wins": "three_crown_wins",
}

OPENED = r"(?:\s*<[a-zA-Z][^>]*>)*"
NUMBER = r"^\s*[+]?(-?[\d,]+(?:\.\d+)?)"
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def opening(*classes: str, tag: str = "[a-zA-Z][a-zA-Z0-9]*+") -> str:
    """Pattern of an opening tag that has all the classes."""
    wanted = "".join(rf"(?=[^>]*?\bclass\s*=\s*[\"'](?:[^\"'>]*\s)?{re.escape(c)}(?=[\s\"']))" for c in classes)
    return rf"<{tag}\b{wanted}[^>]*>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there: a column that is written twice is computed
    twice, and a bound variable is not. An aggregate over nothing hands its start value to its finish."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def each(df: DataFrame, keys: list[str], rows: Column, name: str) -> DataFrame:
    """One row per element that is not null. A plain explode would compute the array once more for a filter on its size."""
    return df.select(*keys, F.explode_outer(rows).alias(name)).filter(F.col(name).isNotNull())


def near(html: Column, text: str) -> Column:
    """The html from the tag on in which the text stands first: a tag with it begins behind the last ``>`` before it, so no
    pattern need try the tags before. Without the text what is left holds no whole tag."""
    return once(F.substring_index(html, text, 1), lambda h: F.substr(html, F.length(h) - F.length(F.substring_index(h, ">", -1)) + 1))


def pieces(html: Column, mark: str, text: str | None = None) -> Column:
    """What begins at each place of the mark, up to the next one. ``text`` stands in every mark."""
    return F.filter(F.split(near(html, text) if text else html, f"(?={mark})"), lambda x: x.rlike(f"^(?:{mark})"))


def known(text: Column) -> Column:
    """Decoded and trimmed; null for an empty text."""

    def decoded(text: Column) -> Column:
        out = text
        for name, character in REFERENCES.items():
            out = F.replace(out, F.lit(name), F.lit(character))
        return F.trim(F.when(text.contains("&"), out).otherwise(text))

    return once(once(text, decoded), lambda t: F.when(t != "", t))


def found(html: Column, pattern: str, group: int = 1) -> Column:
    return known(F.regexp_extract(html, pattern, group))


TAGS = r"(?s)<!--.*?-->|<[^>]*>"


def text_in(html: Column, *classes: str) -> Column:
    """The whole text of the first element of these classes, without the tags in it; of one that is never closed the text
    up to the next tag."""
    closed = opening(*classes, tag="([a-zA-Z][a-zA-Z0-9]*+)")

    def text(part: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(part, rf"(?s){closed}(.*?)</\1\s*>", 2), TAGS, "")
        return F.coalesce(known(whole), found(part, opening(*classes) + OPENED + r"\s*([^<]*)"))

    return once(near(html, classes[0]), text)


def attribute(tag: Column, name: str) -> Column:
    """An attribute of the tag that the piece begins with."""
    return found(tag, rf"^<[^>]*?\b{name}\s*=\s*([\"'])(.*?)\1", 2)


def number(text: Column, kind: str = "double") -> Column:
    return F.regexp_replace(F.regexp_extract(text, NUMBER, 1), ",", "").try_cast("double").cast(kind)


def image(html: Column, *classes: str) -> Column:
    """The first image tag of these classes, whole; empty if there is none."""
    return F.regexp_extract(html, opening(*classes, tag="img"), 0)


def level_of(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit(TXT_LEVEL), F.lit("")), r"^\s*(\d+)\s*$", 1).try_cast("int")


def item_of(tag: Column, level: Column) -> Column:
    flag = lambda key, part: key.contains(part).cast("int")
    return once(
        F.coalesce(attribute(tag, "data-card-key"), F.lit("")),
        lambda key: F.struct(attribute(tag, "alt").alias("name"), level.cast("int").alias("level"), flag(key, TXT_EVOLVED).alias("evo"), flag(key, TXT_HERO).alias("hero")),
    )


def basket(side: Column) -> Column:
    """Eight items and the special one (whose level has a default) of one side."""
    boxes = F.transform(pieces(side, opening(CLS_ITEM_BOX)), lambda b: F.struct(image(b, CLS_ITEM).alias("tag"), level_of(text_in(b, CLS_ITEM_LEVEL)).alias("level")))
    items = F.transform(F.filter(boxes, lambda b: b["tag"] != ""), lambda b: item_of(b["tag"], b["level"]))

    def special(box: Column) -> Column:
        level = F.regexp_extract(box, opening("level") + rf"\s*<div[^>]*>[^<]*</div>\s*<div[^>]*>\s*(?:{TXT_LEVEL})?\s*(\d+)", 1).try_cast("int")
        known_level = once(level, lambda x: F.when(x > 0, x).otherwise(SPECIAL_LEVEL))
        plain = lambda tag: F.struct(attribute(tag, "alt").alias("name"), known_level.alias("level"), F.lit(0).alias("evo"), F.lit(0).alias("hero"))
        return once(image(box, CLS_ITEM), lambda tag: F.when(tag != "", F.array(plain(tag))))

    none = F.array().cast("array<struct<name:string,level:int,evo:int,hero:int>>")
    return F.concat(items, F.coalesce(once(F.get(pieces(side, opening(CLS_SPECIAL_BOX), CLS_SPECIAL_BOX), F.lit(0)), special), none))


def event_parts(div: Column) -> dict[str, Column]:
    """What several columns of an event are made of."""
    return {
        "__sides": pieces(div, opening(CLS_SIDE), CLS_SIDE),
        "__win": F.coalesce(text_in(div, CLS_RIBBON).contains(TXT_WIN), F.lit(False)).cast("int"),
        "__scores": F.split(F.replace(text_in(div, CLS_RESULT), F.lit(" "), F.lit("")), "-"),
        "__change": number(found(near(div, CLS_CHANGE), opening(CLS_CHANGE) + r"(?:\s*<[a-zA-Z][^>]*>)*?\s*" + opening(*CLS_CHANGE_LABEL) + r"\s*([^<]*)"), "long"),
        "__leaks": F.regexp_extract_all(near(div, "name"), F.lit(opening("name") + rf"\s*(?i:{TXT_LEAK})\s*</[^>]*>\s*" + opening("value") + rf"\s*(?:{TXT_LEAK})?\s*([^<]*)"), 1),
    }


def event_columns(div: Column) -> list[Column]:
    """The columns of one event of a history page, with both baskets; the event's parts stand beside it."""
    sides, win, scores, change, leaks = (F.col(c) for c in ("__sides", "__win", "__scores", "__change", "__leaks"))
    last = F.try_element_at(sides, F.lit(-1))
    no_items = F.array().cast("array<struct<name:string,level:int,evo:int,hero:int>>")
    return [
        F.replace(attribute(div, "id"), F.lit("battle_"), F.lit("")).alias("event_id"),
        attribute(div, "data-timestamp").try_cast("double").cast("long").alias("ts"),
        attribute(div, "data-battle-type").alias("type"),
        text_in(div, CLS_MODE).alias("mode"),
        win.alias("win"),
        number(F.get(scores, F.lit(0)), "long").alias("score_for"),
        number(F.get(scores, F.lit(1)), "long").alias("score_against"),
        # A gain on a loss is the opponent's: the value hit a floor.
        F.when((win == 0) & (change > 0), F.lit(0)).otherwise(change).cast("long").alias("change"),
        found(near(last, CLS_NAME_LINK), opening(CLS_NAME_LINK, tag="a").replace("[^>]*>", rf"[^>]*\bhref\s*=\s*[\"'][^\"']*{TXT_NAME_PATH}([^/\"']*)")).alias("opponent"),
        number(F.get(leaks, F.lit(0))).alias("leak_for"),
        number(F.get(leaks, F.lit(1))).alias("leak_against"),
        number(found(near(div, CLS_LEVEL_DIFF), opening(CLS_LEVEL_DIFF) + rf"[^<]*{TXT_LEVEL_DIFF}\s*([^<]*)")).alias("level"),
        F.coalesce(basket(F.get(sides, F.lit(0))), no_items).alias("own_items"),
        F.coalesce(basket(last), no_items).alias("opp_items"),
    ]


def cells_of(row: Column) -> Column:
    """Texts of the cells of a table row, without tags."""
    cells = F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1)
    return F.transform(cells, lambda c: F.coalesce(known(F.regexp_replace(c, r"\s*<[^>]*>\s*", "")), F.lit("")))


def table_rows(html: Column) -> Column:
    return pieces(html, r"<tr\b[^>]*>")


def pairs_of(rows: Column) -> Column:
    """(label, value) of the two-cell rows."""
    two = F.filter(F.transform(rows, cells_of), lambda c: F.size(c) == 2)
    return F.transform(two, lambda c: F.struct(F.lower(F.get(c, F.lit(0))).alias("label"), F.get(c, F.lit(1)).alias("value")))


def value_of(pairs: Column, *labels: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda x: x["label"].isin(*labels)), F.lit(-1))["value"]


def page_profile(html: Column) -> Column:
    """Profile texts; numbers and durations are cleaned later, as Column expressions."""
    rated = F.get(F.filter(pieces(html, opening(CLS_RATING_BLOCK)), lambda b: b.rlike(opening(*CLS_RATING_ICON))), F.lit(0))
    texts = F.regexp_extract_all(rated, F.lit(opening("item") + OPENED + r"\s*([^<]*)"), 1)
    # The season's rows: from its title to the next title row, and no further than its table.
    rows = table_rows(F.regexp_extract(html, rf"(?s){TXT_SEASON}(.*?)(?:</table>|\z)", 1))
    title = lambda rows: F.array_position(F.transform(rows, lambda r: r.contains("<h5") & (F.size(F.regexp_extract_all(r, F.lit(r"<td\b"), 0)) < 2)), F.lit(True))
    to_title = once(rows, lambda r: once(title(r), lambda at: F.when(at > 0, F.slice(r, F.lit(1), at.cast("int") - 1)).otherwise(r)))
    clan = F.coalesce(found(html, opening(CLS_CLAN_BLOCK) + r"(?s:.*?)" + opening(*CLS_CLAN) + OPENED + r"\s*([^<]*)"), F.lit("None"))

    def row(items: Column, season: Column, pairs: Column) -> Column:
        ranks = F.filter(season, lambda x: (x["label"] == "league") | (x["label"] == "rank") & ~F.lower(x["value"]).contains("unranked"))
        return F.struct(
            found(html, opening(CLS_HEAD) + r"(?:\s*<[a-zA-Z][^>]*>)*?\s*<h1[^>]*>\s*([^<]*)").alias("name"),
            once(clan, lambda c: F.when(F.lower(c) == "not in clan", "None").otherwise(c)).alias("clan"),
            known(F.get(items, F.lit(0))).alias("rating"),
            known(F.get(items, F.lit(1))).alias("arena"),
            F.try_element_at(ranks, F.lit(-1))["value"].alias("rank"),
            value_of(season, "trophies", "ratings").alias("ranked_rating"),
            *[value_of(pairs, label).alias(name) for label, name in PROFILE_LABELS.items()],
        )

    return F.array(once(texts, lambda items: once(pairs_of(to_title), lambda season: once(pairs_of(table_rows(html)), lambda pairs: row(items, season, pairs)))))


def page_holdings(html: Column) -> Column:
    """Item, special, hero and evolution holdings; each row changes only its own columns."""

    def row(kind: Column, name: Column, level: Column, present: Column) -> Column:
        return F.struct(kind.alias("kind"), name.alias("name"), level.cast("int").alias("level"), present.cast("int").alias("found"))

    cards = pieces(html, opening(*CLS_HOLDING, tag="a"))
    items = F.transform(cards, lambda c: row(F.lit("item"), attribute(image(c, CLS_ITEM), "alt"), level_of(text_in(c, CLS_HOLDING_LEVEL)), F.lit(1)))

    def of_group(group: Column, special: Column) -> Column:
        minis = F.transform(pieces(group, opening(CLS_MINI[0])), lambda c: F.struct(c.alias("card"), image(c, CLS_MINI[1]).alias("image")))

        def of_card(mini: Column, missing: Column, leveled: Column) -> Column:
            level = F.when(leveled, F.when(missing, 0).otherwise(F.coalesce(level_of(text_in(mini["card"], "level")), F.lit(0))))
            kind = F.when(leveled, "special").when(special, "hero").otherwise("evolution")
            return once(level, lambda n: row(kind, attribute(mini["image"], "alt"), n, F.when(leveled, n > 0).otherwise(~missing)))

        def one(mini: Column) -> Column:
            missing = mini["card"].rlike("^(?:" + opening(CLS_MISSING) + ")")
            leveled = special & mini["card"].rlike(opening("level", tag="div"))
            return once(missing, lambda m: once(leveled, lambda on: of_card(mini, m, on)))

        return F.transform(F.filter(minis, lambda m: m["image"] != ""), one)

    groups = F.transform(
        pieces(html, f"{opening(CLS_SPECIAL_HOLDINGS)}|{opening(CLS_EVOLUTION_HOLDINGS)}", CLS_HOLDINGS),
        lambda g: once(g.rlike("^(?:" + opening(CLS_SPECIAL_HOLDINGS) + ")"), lambda special: of_group(g, special)),
    )
    return F.concat(items, F.flatten(groups))


def page_set_stats(html: Column) -> Column:
    """Statistics per deck: its items, events and the win percentage of the Player row."""

    def of_set(segment: Column) -> Column:
        images = F.regexp_extract_all(segment, F.lit(opening(CLS_ITEM, tag="img")), 0)
        rows = F.filter(F.transform(table_rows(segment), cells_of), lambda c: (F.size(c) > 2) & (F.get(c, F.lit(0)) == TXT_SET_ROW))
        items = F.transform(images, lambda t: item_of(t, F.lit(None)))
        cell = lambda rows, at: F.get(F.get(rows, F.lit(0)), F.lit(at))
        return once(rows, lambda r: F.struct(items.alias("items"), number(cell(r, 1), "long").alias("battles"), number(cell(r, 2)).alias("win_pct"), F.size(r).alias("n")))

    sets = F.filter(F.transform(pieces(html, opening(CLS_SET, tag="div")), of_set), lambda s: (F.size(s["items"]) > 0) & (s["n"] > 0))
    return F.transform(sets, lambda s: F.struct(s["items"].alias("items"), s["battles"].alias("battles"), s["win_pct"].alias("win_pct")))


def page_outline(html: Column) -> Column:
    """Generic outline: title, language, headings, links, ads and the text of the paragraphs, each up to its end tag, the
    next paragraph or the end of the page, without the tags in it. Scripts and styles don't count."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?s)<{tag}\b.*?</{tag}>", "")
    count = lambda pattern: F.size(F.regexp_extract_all(html, F.lit(pattern), 0)).cast("long")
    cuts = F.split(html, r"<p(?:\s[^>]*)?>")
    texts = F.transform(F.slice(cuts, F.lit(2), F.size(cuts)), lambda t: F.regexp_replace(F.regexp_replace(t, r"(?s)</p>.*", ""), r"<[^>]*>", ""))
    return F.array(
        F.struct(
            F.regexp_extract(html, r"<title[^>]*>([^<]*)", 1).alias("title"),
            F.regexp_extract(html, r"<html[^>]*\blang=\"([^\"]*)", 1).alias("lang"),
            count(r"<h[123]\b").alias("headings"),
            count(r"<a\b").alias("links"),
            count(opening("ad")).alias("ads"),
            count(r"<p\b").alias("paragraphs"),
            F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.length(F.trim(t))).alias("text_chars"),
        )
    )


SPECS: dict[str, Callable[[Column], Column]] = {
    "profile": page_profile, "holdings": page_holdings, "set_stats": page_set_stats, "outline": page_outline,
}


def extract_pages(pages: DataFrame, keys: list[str], html: str, spec: str) -> DataFrame:
    """Rows of one kind from all pages; ``keys`` name the page (entity, page id). A null page counts as an empty one."""
    text = F.coalesce(F.col(html), F.lit(""))
    if spec == "events":
        # One row per event before its fields are read, so that only the columns in use are.
        events = each(pages, keys, pieces(text, opening(CLS_EVENT, tag="div")), "__div")
        return events.withColumns(event_parts(F.col("__div"))).select(*keys, *event_columns(F.col("__div")))
    return each(pages, keys, SPECS[spec](text), "__r").select(*keys, "__r.*")


def oldest_on_page(events: DataFrame, keys: list[str]) -> DataFrame:
    """Cursor of the next page: the oldest event time per page."""
    return events.groupBy(*keys).agg(F.min("ts").alias("oldest_ts"))


def clean_profile(raw: DataFrame) -> DataFrame:
    """Typed profile columns from the page texts."""
    numbers = ("rating", "ranked_rating", "wins", "losses", "three_crown_wins", "total_games")
    out = raw.withColumns({c: clean_number(c).cast("long") for c in numbers})
    return out.withColumns(
        {
            "games_per_day": clean_number("games_per_day"),
            "account_age_s": duration_seconds("account_age"),
            "time_spent_s": duration_seconds("time_spent"),
        }
    ).drop("account_age", "time_spent")


def with_set_hash(rows: DataFrame, items: str = "items") -> DataFrame:
    return rows.withColumn("deck_hash", content_hash(items)).withColumn("archetype_hash", content_hash(items, False))


def set_wins(rows: DataFrame) -> DataFrame:
    """Wins from events and percentage."""
    return rows.withColumn("wins", F.round(F.col("battles") * F.col("win_pct") / 100).cast("long"))
