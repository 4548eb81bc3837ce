"""Page observations: fingerprints and their distances, what an action changed, control audits, and message parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.texts import controls

#: Text drift up to which a page counts as restored.
TOLERANCE = 0.05
# Statuses of old labels.
LEGACY = {
    "REVERSIBLE": ("CHANGED", "RECOVERED"), "PARTIALLY_RECOVERABLE": ("CHANGED", "PARTIALLY_RECOVERED"), "PARTIALLY_RECOVERED": ("CHANGED", "PARTIALLY_RECOVERED"),
    "IRREVERSIBLE": ("CHANGED", "NOT_RECOVERED_WITHIN_BUDGET"), "NOT_RECOVERED_WITHIN_BUDGET": ("CHANGED", "NOT_RECOVERED_WITHIN_BUDGET"), "NO_EFFECT": ("NO_EFFECT", "UNKNOWN"), "UNKNOWN": ("UNKNOWN", "UNKNOWN"),
}
DISPLAY = {"RECOVERED": "REVERSIBLE", "PARTIALLY_RECOVERED": "PARTIALLY_RECOVERABLE", "NOT_RECOVERED_WITHIN_BUDGET": "NOT_RECOVERED_WITHIN_BUDGET"}
# Calls that change nothing, roles and words of read-only controls, and words of controls that change something.
HARMLESS = ("send_msg_to_user", "report_infeasible", "noop", "go_back", "go_forward", "scroll", "hover", "new_tab", "tab_close")
READ_ROLES = ("link", "tab", "menuitem", "treeitem")
READ_WORDS = r"(?i)\b(?:search|next|previous|view|details?|filter|sort|go|back|close)\b"
CHANGE_WORDS = (
    r"(?i)\b(?:add\s+to\s+(?:cart|wish\s*list|compare)|subscribe|unsubscribe|upvote|downvote|retract\s+(?:upvote|downvote)|reorder|place\s+order|checkout|delete|remove|refund|pay|purchase|"
    r"publish|create|submit|save|update|edit\s+address|cancel\s+order|confirm\s+order)\b"
)
# Hints of what a page affords, and where an address book shows.
AFFORDED = {"add_to_cart": ("add to cart", "add to bag"), "place_order": ("place order", "proceed to checkout", "checkout", "confirm order"), "delete_address": ("delete", "remove address", "delete address")}
ADDRESS_HINTS = ("address", "/customer/address", "account")


def entities(text: Column) -> Column:
    """Sorted distinct entities that a text names: ``order:n``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)order\s*#?\s*([0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("order:"), n))))


def fingerprint(url: Column, title: Column, text: Column, form: Column, backend: Column) -> Column:
    """struct(url, title, text_hash, shingles, form, entities, backend) of an observation."""
    plain = S.stripped_text(F.coalesce(text, F.lit("")))
    blank = F.lit("")
    return S.once(
        plain,
        lambda p: F.struct(
            F.coalesce(url, blank).alias("url"), F.coalesce(title, blank).alias("title"), F.sha1(p.cast("binary")).alias("text_hash"), S.word_shingles(p).alias("shingles"),
            F.coalesce(form, blank).alias("form"), entities(text).alias("entities"), backend.alias("backend"),
        ),
    )


def state_distance(a: Column, b: Column) -> Column:
    """What differs between two fingerprints; ``backend`` is null unless both sides were observed."""
    return F.struct(
        (a["url"] != b["url"]).alias("url"), (a["title"] != b["title"]).alias("title"), (a["text_hash"] != b["text_hash"]).alias("text"), F.round(S.jaccard_distance(a["shingles"], b["shingles"]), 4).alias("drift"),
        (a["form"] != b["form"]).alias("form"), F.array_sort(F.array_except(b["entities"], a["entities"])).alias("added"), F.array_sort(F.array_except(a["entities"], b["entities"])).alias("removed"), (a["backend"] != b["backend"]).alias("backend"),
    )


def restored(d: Column) -> Column:
    """Whether a distance counts as none: the backend decides where it was observed."""
    quiet = ~d["url"] & ~d["text"] & ~d["form"] & (F.size(d["added"]) == 0) & (F.size(d["removed"]) == 0) & (d["drift"] <= TOLERANCE)
    return F.coalesce(~d["backend"], quiet)


def short_url(url: Column, size: int = 60) -> Column:
    path, query = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    tail = F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.length(tail) > size, F.concat(F.lit("…"), F.substring(tail, -size, size))).otherwise(tail)


def page_label(title: Column, text: Column) -> Column:
    """The title, else the name of the root of the tree."""
    said = F.trim(F.coalesce(title, F.lit("")))
    return F.when(said != "", said).otherwise(F.regexp_extract(F.coalesce(text, F.lit("")), "RootWebArea '([^']+)'", 1))


def observed_delta(d: Column, signal_changed: Column, label: Column, url: Column) -> Column:
    """struct(flag, delta): state-change before nav, update and no-effect; orders named in texts count only beside an observed backend."""
    names = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("#"), F.substring_index(x, ":", -1))), ", ")
    signals = F.array_compact(F.array(F.when(F.size(d["added"]) > 0, F.concat(F.lit("new order "), names(d["added"]))), F.when(F.size(d["removed"]) > 0, F.concat(F.lit("order gone "), names(d["removed"])))))
    told = F.when(d["backend"].isNotNull() & (F.size(signals) > 0), F.array_join(signals, "; ")).otherwise("persistent site signal changed")
    now_on = F.when(d["url"] & (label != ""), F.concat(F.lit(" (now on: "), label, F.lit(")"))).otherwise("")
    said = lambda flag, delta: F.struct(F.lit(flag).alias("flag"), delta.alias("delta"))
    where = F.when(label == "", "new page").otherwise(label)
    return (
        F.when(F.coalesce(d["backend"], F.lit(False)) | F.coalesce(signal_changed, F.lit(False)), said("state-change", F.concat(told, now_on)))
        .when(d["url"], said("nav", F.concat(where, F.lit(" ("), short_url(url), F.lit(")"))))
        .when(d["form"], said("update", F.lit("form values changed (same page)")))
        .when(d["text"] | d["title"] | (F.size(d["added"]) > 0) | (F.size(d["removed"]) > 0), said("update", F.lit("page content changed (same URL)")))
        .otherwise(said("no-effect", F.lit("no visible change")))
    )


def visibility(actions: DataFrame, key: str, action: str, text: str) -> DataFrame:
    """(key, bucket): non_bid for all but clicks, else whether the bid is a control of the text (visible) or not (missing); null actions are invalid."""
    bid = F.regexp_extract(action, r"""^\s*click\(\s*['"]([^'"]+)['"]\s*\)\s*$""", 1)
    t = actions.withColumn("wanted", F.when(bid != "", bid))
    # an exact control, not a bid that stands in prose
    there = controls(t.where("wanted IS NOT NULL"), key, text).select(key, F.col("bid").alias("wanted")).distinct().withColumn("there", F.lit(True))
    bucket = F.when(F.col(action).isNull(), "invalid").when(F.col("wanted").isNull(), "non_bid").when(F.col("there"), "visible").otherwise("missing")
    return t.join(there, [key, "wanted"], "left").select(key, bucket.alias("bucket"))


def control_changes(rows: DataFrame, key: str, before: str, after: str, most: int = 5) -> DataFrame:
    """(key, added, removed): names of controls that appeared or went, the first ``most`` in order."""
    def names(column: str) -> DataFrame:
        return controls(rows, key, column).select(key, F.concat_ws(" ", "role", "name").alias("control")).distinct()

    a, b = names(before).withColumn("old", F.lit(1)), names(after).withColumn("new", F.lit(1))
    both = a.join(b, [key, "control"], "full_outer")
    listed = lambda when: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(when, F.col("control")))), 1, most), "; ")  # noqa: E731  a page's controls
    t = both.groupBy(key).agg(listed(F.col("old").isNull()).alias("added"), listed(F.col("new").isNull()).alias("removed"))
    return rows.select(key).join(t, key, "left").select(key, F.coalesce("added", F.lit("")).alias("added"), F.coalesce("removed", F.lit("")).alias("removed"))


def message_parts(text: Column) -> Column:
    """struct(goal, history, obs) of a user message: three parts, the older two, or the goal alone."""
    # texts are cut at their marks; the lazy parts end at the first next mark
    three = r"(?s)<goal>\s*\n(.*?)\n\s*\n<history>\s*\n(.*?)\n\s*\n<observation>\s*\n(.*)"
    two = r"(?s)<goal>\s*\n(.*?)\n\s*\n<observation>\s*\n(.*)"
    part = lambda pattern, k: F.trim(F.regexp_extract(text, pattern, k), F.lit(" \n\t\r"))
    history = part(three, 2)
    made = lambda goal, past, obs: F.struct(goal.alias("goal"), past.alias("history"), obs.alias("obs"))
    old = F.when(text.rlike(two), made(part(two, 1), F.lit(""), part(two, 2))).otherwise(made(F.trim(text, F.lit(" \n\t\r")), F.lit(""), F.lit("")))
    return F.when(text.rlike(three), made(part(three, 1), F.when(history == "(none)", "").otherwise(history), part(three, 3))).otherwise(old)


def goal_template(state: Column, variant: Column, explicit: int, implicit: int, request: int) -> Column:
    """struct(style, number) of the template of a goal, from hashes of the state alone; the arguments are the sizes of the pools."""
    pick = lambda label, size: S.hash_mod(F.concat(state, F.lit(f"|{label}")), size)
    made = lambda style, number: F.struct(F.lit(style).alias("style"), number.cast("int").alias("number"))
    hidden = S.hash_mod(F.concat(state, F.lit("|style")), 3) == 0
    return F.when(variant == "request", made("request", pick("request", request))).when(hidden, made("implicit_constraint", pick("constraint", implicit))).otherwise(made("explicit_constraint", pick("constraint", explicit)))


def legacy_statuses(label: Column) -> Column:
    """struct(effect, recovery) of an old label; null for a label that is none."""
    word = F.upper(F.coalesce(F.nullif(label, F.lit("")), F.lit("UNKNOWN")))
    made = lambda pair: F.struct(F.lit(pair[0]).alias("effect"), F.lit(pair[1]).alias("recovery"))
    out = F.when(word.startswith("REVERSIBLE_WITH_COST"), made(("CHANGED", "RECOVERED")))
    for old, pair in LEGACY.items():
        out = out.when(word == old, made(pair))
    return out


def display_label(effect: Column, recovery: Column) -> Column:
    out = F.when(effect.isin("NO_EFFECT", "UNKNOWN"), effect)
    for status, shown in DISPLAY.items():
        out = out.when(recovery == status, shown)
    return out.otherwise("UNKNOWN")


def reset_method(value: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")


def read_only_reason(rows: DataFrame, key: str, call: str, url: str, text: str) -> DataFrame:
    """(key, reason): why an action is not surely read-only; null where it is.

    ``call`` is a struct(name, args, bid) of a literal call, null where the action is none; ``args``
    are literals as text.
    """
    c = F.col(call)
    lines = rows.select(key, c["bid"].alias("bid"), F.explode(F.split(text, "\n")).alias("line")).where(F.regexp_extract("line", r"\[([^\]]+)\]", 1) == F.col("bid"))
    hits = lines.groupBy(key).agg(F.count("*").alias("hits"), F.min("line").alias("line"))
    t = rows.join(hits, key, "left")
    pattern = r"\[[^\]]+\]\s+([A-Za-z_][A-Za-z0-9_-]*)\s*(.*)"
    role, label = F.lower(F.regexp_extract("line", pattern, 1)), F.regexp_extract("line", pattern, 2)
    origin = lambda u: F.regexp_extract(u, "^([a-zA-Z]+://[^/?#]+)", 1)
    target = F.get(c["args"], F.lit(0))
    literal = F.regexp_extract(target, "^['\"](.*)['\"]$", 1)
    name = c["name"]
    goto = F.when((F.size(c["args"]) != 1) | (literal == ""), "goto_requires_literal_url").when(origin(F.col(url)) == "", "current_origin_unknown").when(origin(literal) != origin(F.col(url)), "cross_origin_navigation")
    fill = F.when(~(role.isin("searchbox", "textbox") & label.rlike(r"(?i)\bsearch\b")), "fill_not_search_field")
    click = F.when(~role.isin(*READ_ROLES) & ~((role == "button") & label.rlike(READ_WORDS)), F.concat(F.lit("click_role_or_label_not_read_only:"), role))
    control = (
        F.when(F.coalesce(c["bid"], F.lit("")) == "", F.concat(name, F.lit("_missing_bid")))
        .when(F.coalesce("hits", F.lit(0)) != 1, F.concat(name, F.lit("_bid_not_uniquely_visible")))
        .when(role == "", "interactive_role_unparseable")
        .when(label.rlike(CHANGE_WORDS), "mutation_like_control")
        .when(name == "fill", fill)
        .otherwise(click)
    )
    reason = F.when(name.isNull(), "unparseable_action").when(name.isin(*HARMLESS), F.lit(None)).when(name == "goto", goto).when(~name.isin("click", "fill"), F.concat(F.lit("primitive_not_read_only:"), name)).otherwise(control)
    return t.select(key, reason.alias("reason"))


def same_action(a: Column, b: Column) -> Column:
    """Whether two calls struct(name, args, bid) name the same action: by bid where the wanted one (b) has one, else by arguments."""
    return F.coalesce((a["name"] == b["name"]) & F.when(b["bid"].isNotNull(), a["bid"].eqNullSafe(b["bid"])).otherwise(a["args"].eqNullSafe(b["args"])), F.lit(False))


def afforded(text: Column, url: Column) -> Column:
    """Hints of what a page affords, in a fixed order."""
    low, at = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))

    def any_of(c: Column, words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | c.contains(word)
        return out

    found = []
    for kind, words in AFFORDED.items():
        hit = any_of(low, words)
        if kind == "delete_address":
            hit = hit & (any_of(at, ADDRESS_HINTS) | any_of(low, ADDRESS_HINTS))
        found.append(F.when(hit, kind))
    return F.array_compact(F.array(*found))


def site_of(rows: DataFrame, url: str, sites: DataFrame, fallback: Column) -> DataFrame:
    """Adds ``site``: the only one of ``sites`` (site, base) with the origin of the address, else the fallback."""
    origin = lambda c: F.regexp_extract(c, "^([a-zA-Z]+://[^/?#]+)", 1)
    known = sites.select(origin("base").alias("origin"), "site").where("origin <> ''").groupBy("origin").agg(F.min("site").alias("found"), F.count("*").alias("n")).where("n = 1")
    return rows.withColumn("origin", origin(F.col(url))).join(known.drop("n"), "origin", "left").withColumn("site", F.coalesce("found", fallback)).drop("origin", "found")


