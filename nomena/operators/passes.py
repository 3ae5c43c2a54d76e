"""Passes that build a dataset from another: each takes and returns frames of mentions and entities (columns as in sources.datasets and operators.kb)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, years
from .numbering import numbered
from .ranking import keep_first, top_k

#: The entities of theatres whose names lost their last character, and the character.
THEATRES = {10001: "中村座", 10002: "市村座", 10003: "森田座", 10004: "小川座", 10005: "三升座"}
THEATRE_END = "座"
#: Kinds of source that are no persons, the type of mentions of actors, the mark of a record that stands for a name only, the prefix of person records.
NONPERSON = ("yakusya_演目名", "yakusya_書名", "yakusya_役名", "yakusya_音曲", "theater", "yakusya_事項")
ACTOR, NAME_ONLY, PERSONS, PERSON_SOURCE = "役者", "カラ名跡", "ritsumei", "ritsumei_PD"


def _e(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def repair_theatres(d: DataFrame, theatres: dict[int, str] = THEATRES) -> DataFrame:
    """Gives back to the mention the last character of a theatre's name where it heads the right context; a label that repeated the cut mention becomes the theatre's name. Adds nothing."""
    names = F.create_map(*[F.lit(x) for kv in theatres.items() for x in kv])
    cut = F.coalesce(F.col("label_id").isin(*theatres) & ~_e("mention").contains(THEATRE_END) & _e("context_right").startswith(THEATRE_END), F.lit(False))
    return d.select(
        *[c for c in d.columns if c not in ("mention", "context_right", "label_title", "end")],
        F.when(cut, F.concat(_e("mention"), F.lit(THEATRE_END))).otherwise(F.col("mention")).alias("mention"),
        F.when(cut, F.substr("context_right", F.lit(2))).otherwise(F.col("context_right")).alias("context_right"),
        F.when(cut & (_e("label_title") == _e("mention")), F.try_element_at(names, F.col("label_id"))).otherwise(F.col("label_title")).alias("label_title"),
        F.when(cut, F.col("end") + 1).otherwise(F.col("end")).alias("end"),
    )


def distinct_titles(entities: DataFrame) -> DataFrame:
    """Titles without noise; entities that then share one get a cue in brackets, and where the cue came up before among them, the id too."""
    d = entities.withColumn("title", text.clean_title("title"))
    same = Window.partitionBy("title")
    d = d.withColumn("__n", F.count("*").over(same)).withColumn("__cue", text.lineage_cue(F.col("text"), F.col("entity_id")))
    d = d.withColumn("__again", F.row_number().over(Window.partitionBy("title", "__cue").orderBy("pos")) > 1)
    cue = F.when(F.col("__again"), F.concat("__cue", F.lit("#"), F.col("entity_id").cast("string"))).otherwise(F.col("__cue"))
    return d.withColumn("title", F.when(F.col("__n") > 1, F.concat("title", F.lit("("), cue, F.lit(")"))).otherwise(F.col("title"))).drop("__n", "__cue", "__again")


def with_titles(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """label_title as the knowledge base has it, where it has the label."""
    t = entities.select(F.col("entity_id").alias("label_id"), F.col("title").alias("__t"))
    return mentions.join(t, "label_id", "left").withColumn("label_title", F.coalesce("__t", "label_title")).drop("__t")


def fixed(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable labels: distinct titles, labels by them, mentions without noise; rows that were noise only go, of equal ones (mention, label, 80 characters each way) the first in its split stays."""
    entities = distinct_titles(entities)
    d = with_titles(mentions, entities).withColumn("mention", text.strip_noise("mention")).filter(_e("mention") != "")
    d = d.withColumns({"__l": F.right(_e("context_left"), F.lit(80)), "__r": F.left(_e("context_right"), F.lit(80))})
    return keep_first(d, ["split", "mention", "label_id", "__l", "__r"], ["sample_idx"]).drop("__l", "__r"), entities


def persons_only(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The slice of person records, and the mentions whose gold is one."""
    e = entities.filter(F.col("source") == PERSON_SOURCE)
    return mentions.join(e.select(F.col("entity_id").alias("label_id")), "label_id", "left_semi"), e


def relinked(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions with label_id chosen by the year, and `outcome`: orphan, unchanged, gen_changed or base_changed.

    Choices are the entities of the gold's category and query name (or title) that bear the mention's name, and the gold itself; the best has the most flags, then
    the least distance, then the smallest id. Without a year, or with one choice, the gold stays. Choices are scored once for each distinct (mention, year, gold).
    """
    n = text.normalize_name
    bucket = F.struct(_e("category").alias("c"), F.coalesce(F.nullif("query_name", F.lit("")), n("title")).alias("q"))
    e = entities.select("entity_id", "title", "daime", "reading", "birth_year", "death_year", "periods", bucket.alias("bucket"), text.family_base("title").alias("base"))
    asked = mentions.select("mention", F.coalesce("year", F.lit(0)).alias("y"), "label_id").distinct()
    gold = asked.join(e.select(F.col("entity_id").alias("label_id"), "bucket", F.col("base").alias("gold_base")), "label_id")
    c = gold.join(e, "bucket").withColumn("m", n("mention"))
    named = (n("title") == F.col("m")) | F.coalesce(F.exists("periods", lambda p: n(p["name"]) == F.col("m")), F.lit(False))
    c = c.filter(named | (F.col("entity_id") == F.col("label_id")))
    year = years.known(F.col("y"))
    by_year = years.relink_score(F.col("periods"), year, F.col("birth_year"), F.col("death_year"))
    kana = (_e("reading") != "") & F.coalesce(F.exists("periods", lambda p: (_e(p["reading"]) != "") & (n(p["reading"]) == n("reading"))), F.lit(False))
    own = F.coalesce(text.generation(F.col("mention")) == F.col("daime"), F.lit(False))
    flags = by_year["flag"].bitwiseOR(F.when(kana, 2).otherwise(0)).bitwiseOR(F.when(own, 4).otherwise(0))
    best = c.groupBy("mention", "y", "label_id").agg(F.first("gold_base").alias("gold_base"), F.min_by(F.struct("entity_id", "base", "title"), F.struct(-flags, by_year["distance"], "entity_id")).alias("b"))
    d = mentions.withColumn("y", F.coalesce("year", F.lit(0))).join(best, ["mention", "y", "label_id"], "left")
    new = F.when(F.col("b").isNull() | (F.col("y") == 0), F.col("label_id")).otherwise(F.col("b.entity_id"))
    outcome = F.when(F.col("b").isNull(), "orphan").when(new == F.col("label_id"), "unchanged").when(F.col("b.base") == F.col("gold_base"), "gen_changed").otherwise("base_changed")
    title = F.when(new == F.col("label_id"), F.col("label_title")).otherwise(F.col("b.title"))
    d = d.withColumns({"outcome": outcome, "__new": new, "__title": title})
    return d.select(*[c for c in mentions.columns if c not in ("label_id", "label_title")], F.col("__new").alias("label_id"), F.col("__title").alias("label_title"), "outcome")


def with_year_token(mentions: DataFrame) -> DataFrame:
    """The year and the book told at the end of the left context."""
    return mentions.withColumn("context_left", F.concat(_e("context_left"), text.year_token(F.col("year"), F.col("book_name"))))


def recut(mentions: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """Contexts of n characters cut anew from the books' pages, with `aligned`. pages: (book_name, page), one row a book."""
    d = mentions.join(pages, "book_name", "left")
    new = text.recut(F.col("page"), F.col("start"), F.col("end"), F.col("mention"), F.col("context_left"), F.col("context_right"), n)
    return d.withColumn("__c", new).withColumns({"context_left": F.col("__c.left"), "context_right": F.col("__c.right"), "aligned": F.col("__c.aligned")}).drop("__c", "page")


def merged_records(mentions: DataFrame, entities: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record an identity, the one that stands for it, and every gold moved there. canon: (entity_id, canon_id)."""
    kept = entities.join(canon, "entity_id").filter(F.col("entity_id") == F.col("canon_id")).drop("canon_id")
    d = mentions.join(canon.select(F.col("entity_id").alias("label_id"), "canon_id"), "label_id", "left").withColumn("label_id", F.coalesce("canon_id", "label_id")).drop("canon_id")
    return d, kept


def merged_candidates(rows: DataFrame, entities: DataFrame, canon: DataFrame) -> DataFrame:
    """Candidate lists of rows (sample_idx, ans_id, ans_idx, candidates: array<struct<name, text>>) after records were merged.

    A name that one identity alone bears stands for it, and takes its record's title and text; other candidates are told by name and text. The first of each stays; ans_id moves to its identity, ans_idx to the
    place of the first candidate whose name means it, else to the old place or the last; `demoted` tells lists of two or more that became one.
    """
    ids = entities.join(canon, "entity_id")
    names = ids.select(F.explode(F.array_distinct(F.array("title", "entity"))).alias("name"), "canon_id").filter(_e("name") != "")
    names = names.groupBy("name").agg(F.min("canon_id").alias("who"), F.max("canon_id").alias("z")).filter("who = z").drop("z")
    record = entities.select(F.col("entity_id").alias("who"), F.col("title").alias("rt"), F.col("text").alias("rx"))
    c = rows.select("sample_idx", F.posexplode("candidates").alias("i", "c")).select("sample_idx", "i", F.col("c.name").alias("name"), F.col("c.text").alias("text"))
    c = c.join(names, "name", "left").join(record, "who", "left")
    own = F.when(F.col("who").isNotNull(), F.concat(F.lit("id:"), F.col("who").cast("string"))).otherwise(F.concat(F.lit("nm:"), _e("name"), F.lit("\u0001"), _e("text")))
    c = keep_first(c.withColumn("key", own), ["sample_idx", "key"], ["i"])
    c = c.select("sample_idx", "i", F.coalesce("rt", "name").alias("name"), F.when(F.col("text").isNotNull(), F.coalesce("rx", "text")).alias("text"))
    c = c.join(names.withColumnRenamed("who", "means"), "name", "left")
    lists = c.groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("i", "name", "text", "means"))).alias("l"))
    d = rows.join(canon.select(F.col("entity_id").alias("ans_id"), "canon_id"), "ans_id", "left").join(lists, "sample_idx", "left").withColumn("ans", F.coalesce("canon_id", "ans_id"))
    n = F.coalesce(F.size("l"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    hit = F.array_position(F.transform("l", lambda x: F.coalesce(x["means"] == F.col("ans"), F.lit(False))), True)
    at = F.when(F.coalesce(hit, F.lit(0)) > 0, hit - 1).otherwise(F.least(F.coalesce("ans_idx", F.lit(0)), F.greatest(n - 1, F.lit(0)))).cast("int")
    return d.select("sample_idx", F.col("ans").alias("ans_id"), at.alias("ans_idx"), F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"))).alias("candidates"), ((F.size("candidates") >= 2) & (n < 2)).alias("demoted"))


def one_of_slot(candidates: DataFrame) -> DataFrame:
    """Candidates (sample_idx, entity_id, title, label_id) for annotators: of a slot (base name, generation) with a record marked by its category, records without any mark go, and a gold among them moves to the first marked one. Sorted by generation: (sample_idx, entity_id, title, place, label_id)."""
    marked, own_id = F.col("title").rlike(r"[（(]歌舞伎"), F.col("title").rlike(r"[（(]id\d+[)）]")
    slot = ["sample_idx", "slot", "gen"]
    d = candidates.withColumns({"slot": text.base_name("title"), "gen": text.generation_number("title"), "marked": marked, "bare": ~marked & ~own_id})
    keeper = d.filter("marked").groupBy(*slot).agg(F.min_by("entity_id", "pos").alias("keeper"))
    d = d.join(keeper, slot, "left")
    moved = d.filter("bare AND keeper IS NOT NULL AND entity_id = label_id").select("sample_idx", F.col("keeper").alias("to")).distinct()
    d = d.filter("NOT (bare AND keeper IS NOT NULL)").join(moved, "sample_idx", "left").withColumn("label_id", F.coalesce("to", "label_id"))
    return top_k(d, ["sample_idx"], ["gen", "pos"], None, "place").select("sample_idx", "entity_id", "title", "place", "label_id")


def tag_ambiguous(mentions: DataFrame, tag: str = "multi", pool: list[str] | None = None) -> DataFrame:
    """The tag on rows whose mention means two ids or more in its pool (all rows, or those of equal values in `pool`), and on no others; other tags stay, in order; no tags are null."""
    key = ["mention", *(pool or [])]
    d = mentions.withColumn("mention", _e("mention"))
    many = d.groupBy(*key).agg(F.min("label_id").alias("a"), F.max("label_id").alias("z"), F.max(F.col("label_id").isNull().cast("int")).alias("none")).filter("a < z OR (none = 1 AND a IS NOT NULL)").select(*key, F.lit(True).alias("many"))
    d = d.join(many, key, "left")
    rest = F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), tag)
    tags = F.array_sort(F.array_distinct(F.when(F.col("many"), F.array_append(rest, F.lit(tag))).otherwise(rest)))
    return d.withColumn("tags", F.when(F.size(tags) > 0, tags)).drop("many")


def consistent(birth: Column, death: Column, periods: Column, year: Column) -> Column:
    """Whether a person can be meant in a year: in a period, in the lifetime, or within 90 years of a birth without a known death."""
    b, d = years.known(birth), years.known(death)
    return F.coalesce(F.exists(periods, lambda p: years.covers(p["start_year"], p["end_year"], year)), F.lit(False)) | F.coalesce(year.between(b, d), F.lit(False)) | F.coalesce(d.isNull() & year.between(b, b + 90), F.lit(False))


def multi_generation(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of names that two generations or more bore, cleaned, with `outcome`: kept, noise or relinked.

    Equal rows (mention, label, 80 characters before) are taken from test before valid before train, and rows of train's keys only in train. A gold that stands for a name only or was born after the year is
    kept if it was born at most two years later, moved if just one other bearer of the name can be meant, and dropped else.
    """
    e = entities.select("entity_id", text.base_name("title").alias("base"), "title", "daime", "birth_year", "death_year", "periods", "text")
    gens = e.groupBy("base").agg(F.count_distinct(F.coalesce("daime", F.lit("\u0000"))).alias("g")).filter("g >= 2").select("base")
    d = mentions.withColumn("base", text.base_name("mention")).join(gens, "base", "left_semi")
    d = d.withColumns({"k": F.struct(_e("mention").alias("m"), "label_id", F.right(_e("context_left"), F.lit(80)).alias("l")), "yr": years.context_year(F.col("year"), F.col("context_left"), F.col("context_right"))})
    train = mentions.filter("split = 'train'").select(F.struct(_e("mention").alias("m"), "label_id", F.right(_e("context_left"), F.lit(80)).alias("l")).alias("k")).distinct()
    d = d.filter("split = 'train'").unionByName(d.filter("split <> 'train'").join(train, "k", "left_anti"))
    gold = e.select(F.col("entity_id").alias("label_id"), F.col("birth_year").alias("born"), F.coalesce(F.col("text").contains(NAME_ONLY), F.lit(False)).alias("stub"))
    d = d.join(gold, "label_id", "left")
    born, yr = years.known(F.col("born")), years.known(F.col("yr"))
    stub = F.coalesce("stub", F.lit(False))
    bad = stub | F.coalesce(born > yr, F.lit(False))
    noise = bad & ~stub & F.coalesce((born - yr).between(1, 2), F.lit(False))
    d = d.withColumn("state", F.when(~bad, "kept").when(noise, "noise").otherwise("open"))
    asked = d.filter("state = 'open'").select("base", "label_id", "yr").distinct()
    other = asked.join(e.select("base", "entity_id", "title", "birth_year", "death_year", "periods"), "base").filter((F.col("entity_id") != F.col("label_id")) & consistent(F.col("birth_year"), F.col("death_year"), F.col("periods"), years.known(F.col("yr"))))
    only = other.groupBy("base", "label_id", "yr").agg(F.count("*").alias("n"), F.min("entity_id").alias("to"), F.min("title").alias("to_title")).filter("n = 1").drop("n")
    d = d.join(only, ["base", "label_id", "yr"], "left").filter("state <> 'open' OR to IS NOT NULL")
    moved = (F.col("state") == "open") & F.col("to").isNotNull()
    d = d.withColumns({"gold_relinked_from": F.when(moved, F.col("label_id")), "label_title": F.when(moved, F.col("to_title")).otherwise(F.col("label_title")), "outcome": F.when(moved, "relinked").otherwise(F.col("state")), "was": F.col("k")})
    d = d.withColumn("label_id", F.when(moved, F.col("to")).otherwise(F.col("label_id"))).withColumn("k", F.struct(F.col("k.m").alias("m"), "label_id", F.col("k.l").alias("l")))
    turn = F.when(F.col("split") == "test", 0).when(F.col("split") == "valid", 1).otherwise(2)
    # a row goes if a split before has its old key among the keys that it kept; those before are known one split after another
    first = d.filter(turn == 0)
    second = d.filter(turn == 1).join(first.select(F.col("k").alias("was")).distinct(), "was", "left_anti")
    third = d.filter(turn == 2).join(first.select(F.col("k").alias("was")).union(second.select("k")).distinct(), "was", "left_anti")
    return first.unionByName(second).unionByName(third).select(*[c for c in mentions.columns], "gold_relinked_from", "outcome")


def resolved(mentions: DataFrame, entities: DataFrame, canon: DataFrame) -> DataFrame:
    """mentions with `outcome`, and for those that stay label_id of one generation, gold_resolved_from and resolve_by.

    In turn: no actor, no such gold, a person's record (its identity is the gold), a gold that is no person, a name that no person's record has; then by the reading if one person has it,
    by the year if one bearer was active (give or take five), by the name that a bearer held in the year if that leaves one; else unresolved. Answers are worked out once for each distinct (gold, mention, year).
    """
    c = entities.join(canon, "entity_id")
    person = F.col("idx").startswith(PERSONS)
    e = c.select("entity_id", "canon_id", "title", person.alias("person"), text.base_name("title").alias("base"), text.squeeze("reading").alias("rd"), F.split("idx", ":")[0].alias("kind"), "birth_year", "death_year", "periods")
    bearers = e.filter("person").groupBy("base").agg(F.collect_set("canon_id").alias("ids"))
    readers = e.filter("person").groupBy("rd").agg(F.min("canon_id").alias("reader"), F.max("canon_id").alias("z")).filter("reader = z AND rd <> ''").drop("z")
    gold = e.select(F.col("entity_id").alias("label_id"), F.col("canon_id").alias("gold_canon"), F.col("person").alias("gold_person"), "base", "rd", "kind").join(bearers, "base", "left").join(readers, "rd", "left")
    d = mentions.withColumns({"yr": years.context_year(F.lit(None).cast("int"), F.col("context_left")), "mb": text.base_name("mention")})
    d = d.withColumn("k", F.struct("label_id", "mb", F.coalesce("yr", F.lit(-1)).alias("yr")))
    asked = d.select("k", "label_id", "mb", "yr").distinct().join(gold, "label_id")
    none = F.array().cast("array<int>")
    bounds = lambda f: F.coalesce(F.transform("periods", lambda p: years.known(p[f])), none)
    life = e.select(F.col("entity_id").alias("id"), "periods", F.array_compact(F.concat(bounds("start_year"), bounds("end_year"), F.array(years.known(F.col("birth_year")), years.known(F.col("death_year"))))).alias("all"))
    life = life.select("id", F.array_min("all").alias("low"), F.array_max("all").alias("high"), "periods")
    one = asked.filter("ids IS NOT NULL AND reader IS NULL AND yr IS NOT NULL").select("k", "mb", "yr", F.explode("ids").alias("id")).join(life, "id").filter("yr BETWEEN low - 5 AND high + 5")
    held = F.get(F.filter("periods", lambda p: years.covers(p["start_year"], p["end_year"], F.col("yr"))), F.lit(0))["name"]
    same = held.isNotNull() & (text.base_name(held) == F.col("mb"))
    one = one.groupBy("k").agg(F.count("*").alias("active"), F.min("id").alias("only"), F.count_if(same).alias("named"), F.min(F.when(same, F.col("id"))).alias("name_only"))
    a = asked.join(one, "k", "left").select("k", "gold_canon", "gold_person", "kind", "ids", "reader", "active", "only", "named", "name_only")
    d = d.join(a, "k", "left")
    outcome = (
        F.when(F.coalesce("type", F.lit("")) != ACTOR, "drop_non_actor")
        .when(F.col("gold_canon").isNull(), "drop_missing")
        .when(F.col("gold_person") | (F.col("gold_canon") != F.col("label_id")), "person")
        .when(F.col("kind").isin(*NONPERSON), "drop_nonperson_gold")
        .when(F.col("ids").isNull(), "drop_out_of_db")
        .when(F.col("reader").isNotNull(), "reading")
        .when(F.col("active") == 1, "year")
        .when((F.col("active") >= 2) & (F.col("named") == 1), "name_year")
        .otherwise("drop_unresolved")
    )
    new = F.when(outcome == "person", F.col("gold_canon")).when(outcome == "reading", F.col("reader")).when(outcome == "year", F.col("only")).when(outcome == "name_year", F.col("name_only"))
    d = d.withColumn("outcome", outcome).withColumn("new", new)
    titles = entities.select(F.col("entity_id").alias("new"), F.col("title").alias("new_title"))
    d = d.join(titles, "new", "left")
    title = F.when(F.col("outcome").isin("reading", "year", "name_year"), F.col("new_title")).otherwise(F.col("label_title"))
    return d.select(*[c for c in mentions.columns if c not in ("label_id", "label_title")], F.coalesce("new", "label_id").alias("label_id"), title.alias("label_title"), F.when(F.col("new").isNotNull(), F.col("label_id")).alias("gold_resolved_from"), F.when(F.col("new").isNotNull(), F.col("outcome")).alias("resolve_by"), "outcome")


def repaired_periods(entities: DataFrame) -> DataFrame:
    """Entities without the dated names that can't be theirs; nothing is added, and a second pass changes nothing."""
    return entities.withColumn("periods", years.own_periods(F.col("periods"), F.col("birth_year"), F.col("death_year")))


def periods_in_text(c: Column, periods: Column, mark: str = "名乗期間") -> Column:
    """A text whose tail, from the mark on, tells the dated names as JSON; a text without the mark stays."""
    at = F.instr(F.coalesce(c, F.lit("")), mark)
    return F.when((at > 0) & (F.size(periods) > 0), F.concat(F.left(c, at - 1), F.lit(mark + ": "), F.to_json(periods))).otherwise(c)


def with_added(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Static entities (title, category) appended with numbers from the greatest on, in order of title."""
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(-1)).alias("e"), F.coalesce(F.max("pos"), F.lit(-1)).alias("p")).first()
    n = F.row_number().over(Window.orderBy("title"))  # a stated, small list
    more = names.select((F.lit(top["e"]) + n).cast("int").alias("entity_id"), (F.lit(top["p"]) + n).cast("long").alias("pos"), "title", "category")
    return entities.unionByName(more, allowMissingColumns=True)


def entities_from_mentions(mentions: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A knowledge base from annotations: (entities, mentions with gold). records: (name, record_id, title, ...) of an outside database of actors.

    Mentions are grouped by type and normal form. An actor's name gives an entity for each of its records, or one that stands for the name if there is none; another name gives one. The gold is the first entity of
    the group, -1 for an empty name.
    """
    d = mentions.withColumns({"name": text.normalize_name("mention"), "kind": _e("type")})
    groups = d.filter("name <> ''").groupBy("kind", "name").agg(F.min("sample_idx").alias("first"), F.min_by("mention", "sample_idx").alias("mention"), F.count("*").alias("mentions_count"))
    r = groups.join(records.withColumnRenamed("title", "record_title"), "name", "left").withColumn("record_id", F.when(F.col("kind") == ACTOR, F.col("record_id")))
    r = keep_first(r, ["kind", "name", "record_id"], ["first"])
    title = F.when(F.col("record_id").isNotNull(), F.col("record_title")).when(F.col("kind") == ACTOR, F.concat("mention", F.lit("〈1〉"))).otherwise(F.col("mention"))
    e = numbered(r, ["first", F.col("record_id").asc_nulls_first()], "entity_id").withColumn("entity_id", F.col("entity_id").cast("int")).withColumn("title", title)
    gold = e.groupBy("kind", "name").agg(F.min("entity_id").alias("label_id"))
    linked = d.drop("label_id").join(gold, ["kind", "name"], "left").withColumn("label_id", F.coalesce("label_id", F.lit(-1))).drop("kind", "name")
    return e.select("entity_id", F.col("entity_id").cast("long").alias("pos"), "title", F.col("kind").alias("category"), "name", "record_id", "mentions_count"), linked


def random_split(mentions: DataFrame, by: str = "label_id", test: float = 0.1, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """mentions with `split` by a seeded digest of the key: whole keys go to one split, about a tenth each to test and valid, wherever the rows lie."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return mentions.withColumn("split", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def merged_caches(entities: DataFrame, caches: DataFrame, columns: list[str]) -> DataFrame:
    """Fields that models told (entity_id, model, the columns) fill what an entity lacks: of several models the first by name; what is known stays."""
    best = keep_first(caches, ["entity_id"], ["model"]).select("entity_id", *[F.col(c).alias(f"__{c}") for c in columns])
    d = entities.join(best, "entity_id", "left")
    have = set(entities.columns)
    return d.select(*[c for c in entities.columns if c not in columns], *[(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) if c in have else F.col(f"__{c}")).alias(c) for c in columns])


def cluster_aliases(variants: DataFrame) -> DataFrame:
    """(head, aliases): the other names of each cluster's members, in order. variants: (name, head)."""
    return variants.groupBy("head").agg(F.collect_set("name").alias("names")).select("head", F.array_sort(F.array_remove("names", F.col("head"))).alias("aliases"))


def without_leak(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose mention, label and last 80 characters of left context are not in train."""
    k = F.struct(_e("mention").alias("m"), "label_id", F.right(_e("context_left"), F.lit(80)).alias("l"))
    return rows.withColumn("__k", k).join(train.select(k.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def probe(parts: dict[str, DataFrame]) -> DataFrame:
    """All splits as one benchmark, with origin_split and heldout (all but train)."""
    return reduce(DataFrame.unionByName, [d.withColumns({"origin_split": F.lit(s), "heldout": F.lit(s != "train"), "split": F.lit("test")}) for s, d in parts.items()])
