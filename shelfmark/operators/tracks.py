"""Track lists from files, tracks heard in files, and entries that look like one track."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.functions.text import folded
from shelfmark.operators.graph import kept
from shelfmark.operators.resolve import assign_greedily, guarded_groups

#: Seconds of a whole-disc image, files beside which it is one, and seconds by which copies may differ.
IMAGE_SECONDS, IMAGE_FILES, SAME_SECONDS = 25 * 60, 3, 2
#: Ms by which entries of one title may differ, and the most that one recording's files may, as a share.
TITLE_MS, MASTER_SHARE = 3000, 1.2
#: What track lists need of a file.
FILE = ["id", "disc", "track", "title", "name", "title_key", "seconds", "lossless", "audio", "linked", "said"]


def track_files(files: DataFrame) -> DataFrame:
    """The files that may be tracks: not marked as extra; no whole-disc image where there are more than three files."""
    some = files.where(F.coalesce("role", F.lit("")) != "extra").drop("role") if "role" in files.columns else files
    n = F.count(F.lit(1)).over(Window.partitionBy("edition"))
    image = (F.coalesce("seconds", F.lit(0.0)) > IMAGE_SECONDS) & (F.col("n_files") > IMAGE_FILES)
    return some.withColumn("n_files", n).where(~image).drop("n_files")


def _roots(files: DataFrame) -> DataFrame:
    """(edition, id, root): the file that opens the row each file stands in.

    Files have an order: numbered ones first, then by id. Where the first file of a sound has a number, all files of that sound have
    its disc, number and name, and the first file of these opens their row. Of the others, one of a sound follows the first of that
    sound; the first one follows the first file of its name, if there is an earlier one and the file that opens that one's row is as
    long; else it opens a row. Followed files are earlier ones, and rounds resolve those that follow a resolved one.
    """
    order = F.struct(F.col("track").isNull().alias("late"), "id", "disc", "track", "name")
    sound, name = Window.partitionBy("edition", "audio"), Window.partitionBy("edition", "name")
    f = files.select("edition", "id", "disc", "track", "name", "audio", "seconds")
    f = f.withColumns({"lead": F.when(F.col("audio").isNull(), order).otherwise(F.min(order).over(sound)), "named": F.min(order).over(name)["id"]})
    place = Window.partitionBy("edition", "lead.disc", "lead.track", "lead.name")
    first = F.min(F.when(F.col("track").isNotNull(), F.struct("id", "seconds"))).over(place)
    f = kept(f.withColumn("opens", F.when(~F.col("lead.late"), first)))
    opened = F.when(F.col("opens").isNotNull(), F.col("opens")).when((F.col("lead.id") == F.col("id")) & (F.col("named") == F.col("id")), F.struct("id", "seconds"))
    done = kept(f.withColumn("x", opened).where("x is not null").select("edition", "id", F.col("x.id").alias("root"), F.col("x.seconds").alias("root_seconds")))
    follows = F.when(F.col("lead.id") != F.col("id"), F.struct(F.col("lead.id").alias("of"), F.lit(False).alias("by_name"))).otherwise(F.struct(F.col("named").alias("of"), F.lit(True).alias("by_name")))
    todo = kept(f.where(opened.isNull()).select("edition", "id", "seconds", follows.alias("x")).select("edition", "id", "seconds", "x.of", "x.by_name"))
    parts = [done]
    while not todo.isEmpty():
        met = todo.join(parts[-1].select("edition", F.col("id").alias("of"), "root", "root_seconds"), ["edition", "of"])
        joins = ~F.col("by_name") | F.coalesce(F.abs(F.col("seconds") - F.col("root_seconds")) <= SAME_SECONDS, F.lit(True))
        new = kept(met.select("edition", "id", F.when(joins, F.col("root")).otherwise(F.col("id")).alias("root"), F.when(joins, F.col("root_seconds")).otherwise(F.col("seconds")).alias("root_seconds")))
        parts.append(new)
        todo = kept(todo.join(new.select("edition", "id"), ["edition", "id"], "left_anti"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("edition", "id", "root")


def track_lists(files: DataFrame, entries: DataFrame, heard_in: DataFrame | None = None, most_in_row: int = 500) -> DataFrame:
    """A track list for each edition from its files: edition, disc, position, title, seconds, track, files, new_disc, new_position and
    relinked.

    files: edition, id, disc, track, title, name (its exact key), title_key, seconds, lossless, audio (a checksum), linked (a track),
    and perhaps role; entries, of the edition's release: edition, track, name, title_key, listed (how many editions list it), and perhaps
    position; heard_in: file, track, and edition where a file's id is its own only there. Files of one sound, of one disc, number and name, or of one name and length make a row; it says
    what its first lossless file says, else its first file. Rows stand by disc, number (none last) and title of their first file. In
    that order each takes its best track that is free: one that its files are linked to or, if not linked, heard as; the one of its
    exact name, the one of its title key (the most listed of equals). A row without a track is a new one: in its own place where the
    release has no entries, else after them. Relinked are the files that aren't linked to the row's track.
    """
    f = files.where(F.coalesce("role", F.lit("")) != "extra") if "role" in files.columns else files
    if heard_in is not None:
        on = ["edition", "id"] if "edition" in heard_in.columns else ["id"]
        f = f.join(heard_in.withColumnsRenamed({"file": "id", "track": "heard"}).select(*on, "heard"), on, "left").withColumn("said", F.coalesce("linked", "heard"))
    else:
        f = f.withColumn("said", F.col("linked"))
    f = f.select("edition", F.struct(*FILE).alias("file"))
    e = entries.select("edition", F.struct(*(c for c in entries.columns if c != "edition")).alias("entry"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    return track_lists_of(f.select("edition", "file", none(e, "entry")).unionByName(e.select("edition", none(f, "file"), "entry")), most_in_row=most_in_row)


def track_lists_of(facts: DataFrame, sizes: DataFrame | None = None, most_in_row: int = 500) -> DataFrame:
    """The same from facts: edition, file (a struct of FILE, said being the track it is linked to or heard as) and entry (a struct of track,
    name, title_key, listed, and perhaps position), either of which may be null; extra files aren't among them.

    An edition's facts meet in one row, so facts move once, and not at all where they are dealt out by edition already. Editions of more
    than ``most_in_row`` facts, if there are any, are found by joins and rounds. sizes: edition and n, where a bound of the facts is known.
    """
    sizes = facts.groupBy("edition").agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    large = kept(sizes.where(F.col("n") > most_in_row).select("edition"))
    if large.isEmpty():
        return _in_rows(facts)
    few = F.broadcast(large) if large.count() <= 10_000 else large
    many = kept(facts.join(few, "edition", "left_semi"))
    part = lambda c: many.where(F.col(c).isNotNull()).select("edition", f"{c}.*")
    return _in_rows(facts.join(few, "edition", "left_anti")).unionByName(_in_rounds(part("file"), part("entry")))


def _opened(files: Column, kind: str) -> Column:
    """An edition's files in their order as (file, opened): opened is the file that opens its row, by the rules of ``_roots``."""

    def follow(acc: Column, f: Column) -> Column:
        first = lambda like: F.slice(F.filter(acc, like), 1, 1)
        at = lambda x: x["file"]["disc"].eqNullSafe(f["disc"]) & (x["file"]["track"] == f["track"]) & x["file"]["name"].eqNullSafe(f["name"])
        sound = first(lambda x: x["file"]["audio"] == f["audio"])
        place = first(lambda x: (x["file"]["id"] == x["opened"]["id"]) & at(x))
        named = first(lambda x: f["late"] & x["file"]["name"].eqNullSafe(f["name"]))
        close = F.filter(named, lambda x: F.coalesce(F.abs(f["seconds"] - x["opened"]["seconds"]) <= SAME_SECONDS, F.lit(True)))
        opened = F.coalesce(F.get(F.concat(sound, place, close), F.lit(0))["opened"], F.struct(f["id"].alias("id"), f["seconds"].alias("seconds")))
        return F.concat(acc, F.array(F.struct(f.alias("file"), opened.alias("opened"))))

    return F.aggregate(files, F.array().cast(kind), follow)


def _taken(rows: Column, entries: Column, kind: str, track: DataType) -> Column:
    """An edition's rows in their order as (row, track, position, before): the best free track, the place on the disc, and how many rows
    before it are new."""

    def take(acc: Column, r: Column) -> Column:
        said = F.filter(F.transform(r["of"], lambda y: y["said"]), lambda w: w.isNotNull() & F.exists(entries, lambda e: e["track"].eqNullSafe(w)))
        best = lambda key: F.array_max(F.transform(F.filter(entries, lambda e: e[key] == r["main"][key]), lambda e: F.struct(e["listed"], e["track"])))["track"]
        wishes = F.concat(F.transform(said, lambda w: w.cast(track)), F.array(best("name"), best("title_key")))
        free = F.filter(wishes, lambda w: w.isNotNull() & ~F.exists(acc, lambda a: a["track"].eqNullSafe(w)))
        place = F.size(F.filter(acc, lambda a: a["row"]["disc"].eqNullSafe(r["disc"]))) + 1
        before = F.size(F.filter(acc, lambda a: a["track"].isNull()))
        return F.concat(acc, F.array(F.struct(r.alias("row"), F.get(free, F.lit(0)).alias("track"), place.alias("position"), before.alias("before"))))

    return F.aggregate(rows, F.array().cast(kind), take)


def _in_rows(facts: DataFrame) -> DataFrame:
    """Track lists of editions whose files and entries fit in one row each."""
    late = F.col("file.track").isNull().alias("late")
    file = F.when(F.col("file").isNotNull(), F.struct(late, *(F.col(f"file.{c}").alias(c) for c in FILE)))
    x = facts.groupBy("edition").agg(F.array_sort(F.collect_list(file)).alias("files"), F.collect_list("entry").alias("entries"))
    kinds = {c: x.schema[c].dataType.elementType for c in ("files", "entries")}
    one, seconds, track = kinds["files"].simpleString(), kinds["files"]["seconds"].dataType.simpleString(), kinds["entries"]["track"].dataType
    image = lambda f: (F.coalesce(f["seconds"], F.lit(0.0)) > IMAGE_SECONDS) & (F.size("files") > IMAGE_FILES)
    opened = _opened(F.filter("files", lambda f: ~image(f)), f"array<struct<file:{one},opened:struct<id:{kinds['files']['id'].dataType.simpleString()},seconds:{seconds}>>>")
    x = x.select("edition", "entries", opened.alias("files"))
    of = lambda f: F.transform(F.filter("files", lambda y: y["opened"]["id"] == f["id"]), lambda y: y["file"])
    rows = F.transform(F.filter("files", lambda y: y["file"]["id"] == y["opened"]["id"]), lambda y: F.struct(y["file"].alias("first"), of(y["file"]).alias("of")))
    main = lambda r: F.array_min(F.transform(r["of"], lambda y: F.struct((~y["lossless"]).alias("lossy"), *(y[c].alias(c) for c in ("late", "id", "title", "seconds", "name", "title_key")))))
    place = lambda f: (f["disc"].alias("disc"), F.coalesce(f["track"], F.lit(999)).alias("number"), *(f[c].alias(c) for c in ("title", "late", "id")))
    x = x.select("edition", "entries", F.array_sort(F.transform(rows, lambda r: F.struct(*place(r["first"]), r["of"].alias("of"), main(r).alias("main")))).alias("rows"))
    taken = _taken(F.col("rows"), F.col("entries"), f"array<struct<row:{x.schema['rows'].dataType.elementType.simpleString()},track:{track.simpleString()},position:int,before:int>>", track)
    has = "position" in kinds["entries"].fieldNames()
    last = F.array_max("entries.position") if has else F.size(F.array_distinct(F.filter("entries.track", lambda t: t.isNotNull())))
    x = x.select("edition", F.when(F.size("entries") > 0, last).cast("int").alias("last"), F.explode(taken).alias("x")).select("edition", "last", "x.row", "x.track", "x.position", "x.before")
    return _listed(x, F.col("row.disc"), F.col("row.main"), F.col("row.of"), F.col("before") + 1)


def _listed(rows: DataFrame, disc: Column, main: Column, of: Column, nth: Column) -> DataFrame:
    """The columns of track lists. nth: a new row's place among those of its edition."""
    new = F.col("track").isNull()
    ids = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["id"])), ",")
    return rows.select(
        "edition", disc.alias("disc"), "position", main["title"].alias("title"), main["seconds"].alias("seconds"), "track", ids(of).alias("files"),
        F.when(new, F.when(F.col("last").isNull(), disc).otherwise(1)).alias("new_disc"), F.when(new, F.coalesce(F.col("last") + nth, "position")).alias("new_position"),
        ids(F.filter(of, lambda x: ~x["linked"].eqNullSafe(F.col("track")) | F.col("track").isNull())).alias("relinked"),
    )


def _in_rounds(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Track lists of editions of any size, by joins, windows and rounds."""
    f, entries = kept(track_files(files)), kept(entries)
    f = f.join(_roots(f), ["edition", "id"])
    late = F.col("track").isNull()
    rows = f.groupBy("edition", "root").agg(
        F.min(F.struct(late.alias("late"), "id", "disc", F.coalesce("track", F.lit(999)).alias("number"), "title")).alias("first"),
        F.min(F.struct((~F.col("lossless")).alias("lossy"), late.alias("late"), "id", "title", "seconds", "name", "title_key")).alias("main"),
        F.array_sort(F.collect_list(F.struct(late.alias("late"), "id", "said", "linked"))).alias("of"),
    )
    at = lambda *by: F.row_number().over(Window.partitionBy("edition", *by).orderBy("first.disc", "first.number", "first.title", "first.late", "first.id"))
    rows = kept(rows.withColumns({"row": at(), "position": at("first.disc")}))

    known = entries.select("edition", "track").distinct()
    best = lambda key: entries.groupBy("edition", F.col(key).alias("key")).agg(F.max(F.struct("listed", "track"))["track"].alias("track"))
    said = rows.select("edition", "row", F.posexplode("of").alias("near", "x")).select("edition", "row", F.col("x.said").alias("track"), "near").where("track is not null").join(known, ["edition", "track"])
    by_name = lambda key, near: rows.select("edition", "row", F.col(f"main.{key}").alias("key")).join(best(key), ["edition", "key"]).select("edition", "row", "track", F.lit(near).alias("near"))
    wishes = said.select("edition", "row", "track", "near").unionByName(by_name("name", 2**30)).unionByName(by_name("title_key", 2**30 + 1))
    wishes = wishes.groupBy("edition", F.col("row").alias("left"), F.col("track").alias("right")).agg(F.min("near").alias("near")).withColumn("score", -F.col("left"))
    taken = assign_greedily(wishes, "edition").select("edition", F.col("left").alias("row"), F.col("right").alias("track"))

    place = F.max("position") if "position" in entries.columns else F.count_distinct("track")
    last = entries.groupBy("edition").agg(place.cast("int").alias("last"))
    rows = rows.join(taken, ["edition", "row"], "left").join(last, "edition", "left")
    nth = F.count_if(F.col("track").isNull()).over(Window.partitionBy("edition").orderBy("row")).cast("int")
    return _listed(rows, F.col("first.disc"), F.col("main"), F.col("of"), nth)


def heard(evidence: DataFrame, listed: DataFrame) -> DataFrame:
    """(file, track) from evidence (file, track) and what editions list (edition, track).

    A file heard as several tracks counts only if no edition lists two of them; then the one that most editions list (ties: the least)
    is it. Files meet editions through their tracks, so no two tracks of a file are compared.
    """
    found, where = evidence.select("file", "track").distinct(), listed.select("edition", "track").distinct()
    clash = found.join(where, "track").groupBy("file", "edition").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file").distinct()
    n = where.groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    best = found.join(clash, "file", "left_anti").join(n, "track", "left").groupBy("file").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("less"), "track")).alias("k"))
    return best.select("file", "k.track")


def same_entries(tracks: DataFrame, rows: DataFrame, files: DataFrame, masters: DataFrame) -> DataFrame:
    """(release, a, b, rank): evidence that two entries of a release are one track, strongest first.

    0: files of one sound; 1: files of one recording (masters: a, b), the longer at most 1.2 times the shorter, if there is no sound;
    2: a title in common, lengths within 3 s where known. tracks (release, track, title, ms), rows (release, edition, track, title),
    files (release, track, file, audio, seconds). A release's own entries bound what meets.
    """
    pair = lambda x, y, on: x.alias("x").join(y.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on] + [F.col("x.track") < F.col("y.track")])
    ends = lambda df, rank: df.select(F.col("x.release").alias("release"), F.col("x.track").alias("a"), F.col("y.track").alias("b"), F.lit(rank).alias("rank")).distinct()
    heard_ = files.where("audio is not null").select("release", "track", "audio").distinct()
    sound = ends(pair(heard_, heard_, ["release", "audio"]), 0)
    side = lambda of, name: files.select(F.col("file").alias(of), F.struct("release", "track", "seconds").alias(name))
    met = masters.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").where((F.col("x.release") == F.col("y.release")) & (F.col("x.track") != F.col("y.track")))
    long_ = F.greatest("x.seconds", "y.seconds") <= MASTER_SHARE * F.least("x.seconds", "y.seconds")
    near = met.where(long_ & (F.least("x.seconds", "y.seconds") > 0))
    near = near.select("x.release", F.least("x.track", "y.track").alias("a"), F.greatest("x.track", "y.track").alias("b"), F.lit(1).alias("rank")).distinct().join(sound, ["release", "a", "b"], "left_anti")
    first = files.groupBy("release", "track").agg(F.min(F.struct("file", "seconds"))["seconds"].alias("seconds"))
    length = tracks.join(first, ["release", "track"], "left").select("release", "track", F.coalesce("ms", F.col("seconds") * 1000).alias("ms"))
    keyed = names(tracks, rows).select("release", "track", folded("exact_key", "name").alias("key")).where("key <> ''").distinct().join(length, ["release", "track"])
    titled = ends(pair(keyed, keyed, ["release", "key"]).where(F.coalesce(F.abs(F.col("x.ms") - F.col("y.ms")) <= TITLE_MS, F.lit(True))), 2)
    return sound.unionByName(near).unionByName(titled)


def names(tracks: DataFrame, rows: DataFrame) -> DataFrame:
    """(release, track, name): an entry's title, and the titles its rows have, each as often as it is used."""
    own = tracks.select("release", "track", F.col("title").alias("name"))
    return own.unionByName(rows.select("release", "track", F.col("title").alias("name"))).where("name is not null")


def duplicate_entries(tracks: DataFrame, rows: DataFrame, files: DataFrame, masters: DataFrame) -> DataFrame:
    """(release, label, tracks, title, why): groups of entries that look like one track; rows and files also name their edition.

    Evidence is followed by rank, then by entries, while no edition would list two entries of a group. The proposed title is the most
    used one; of equals the one with accents, then the shortest, then the first.
    """
    edges = kept(same_entries(tracks, rows, files, masters))
    placed = kept(rows.select("release", "edition", "track").unionByName(files.select("release", "edition", "track")).distinct())
    guards = placed.groupBy("release", "track").agg(F.array_sort(F.collect_set("edition")).alias("guard"))
    none = F.array().cast(guards.schema["guard"].dataType)
    guard = lambda at, name: guards.select("release", F.col("track").alias(at), F.col("guard").alias(name))
    guarded = edges.join(guard("a", "ga"), ["release", "a"], "left").join(guard("b", "gb"), ["release", "b"], "left")
    guarded = guarded.select("release", F.col("a").alias("node"), F.coalesce("ga", none).alias("guard"), F.col("b").alias("other"), F.coalesce("gb", none).alias("other_guard"), "rank")
    label = kept(guarded_groups(guarded, "release"))
    a, b = (label.select("release", F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    why = F.element_at(F.array(F.lit("audio"), F.lit("recording"), F.lit("title")), F.col("rank") + 1)
    reasons = edges.join(a, ["release", "a"]).join(b, ["release", "b"]).where("a_label = b_label").groupBy("release", F.col("a_label").alias("label")).agg(F.array_join(F.array_sort(F.collect_set(why)), ",").alias("why"))
    members = label.select("release", F.col("node").alias("track"), "label")
    first = placed.groupBy("release", "track").agg(F.min("edition").alias("edition"))
    order = F.struct(F.col("edition").isNull().alias("none"), "edition", "track")
    listed = members.join(first, ["release", "track"], "left").groupBy("release", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["track"].cast("string")), ",").alias("tracks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    used = names(tracks, rows).join(members, ["release", "track"]).groupBy("release", "label", "name").agg(F.count(F.lit(1)).alias("n"))
    plain = folded("fold_latin", "name") == F.col("name")
    title = used.withColumn("plain", plain).groupBy("release", "label").agg(F.min(F.struct((-F.col("n")).alias("less"), "plain", F.length("name").alias("size"), "name"))["name"].alias("title"))
    return listed.join(title, ["release", "label"], "left").join(reasons, ["release", "label"]).select("release", "label", "tracks", "title", "why")


def duplicate_entries_of(facts: DataFrame, alike: Callable[[Column, Column], Column], sizes: DataFrame | None = None, most_in_row: int = 200) -> DataFrame:
    """The same from facts of releases: entry (track, title, key, plain, ms), row (edition, track, title, key, plain) and file (edition, track,
    file, audio, seconds), structs of which each may be null. key is the title's exact key, plain whether it has no accents; alike
    says of two files, the lesser first, whether they are one recording's.

    A release's facts meet in one row, so facts move once, and not at all where they are dealt out by release already. Releases of more
    than ``most_in_row`` facts, if there are any, are found by joins. sizes: release and n, where a bound of the facts is known.
    """
    sizes = facts.groupBy("release").agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    large = kept(sizes.where(F.col("n") > most_in_row).select("release"))
    if large.isEmpty():
        return _duplicates_in_rows(facts, alike)
    few = F.broadcast(large) if large.count() <= 10_000 else large
    many = kept(facts.join(few, "release", "left_semi"))
    part = lambda c: many.where(F.col(c).isNotNull()).select("release", f"{c}.*")
    files = part("file")
    x, y = files.alias("x"), files.alias("y")
    masters = x.join(y, (F.col("x.release") == F.col("y.release")) & (F.col("x.file") < F.col("y.file")) & alike(F.col("x.file"), F.col("y.file"))).select(F.col("x.file").alias("a"), F.col("y.file").alias("b")).distinct()
    whole = duplicate_entries(part("entry").select("release", "track", "title", "ms").distinct(), part("row").select("release", "edition", "track", "title"), files, masters)
    return _duplicates_in_rows(facts.join(few, "release", "left_anti"), alike).unionByName(whole)


def _met(of: str, meet: Callable[[Column, Column], Column]) -> Column:
    """Pairs (a, b) of tracks, the lesser first, of which elements of an array meet."""
    ends = lambda x, y: F.struct(F.least(x["track"], y["track"]).alias("a"), F.greatest(x["track"], y["track"]).alias("b"))
    return F.array_distinct(F.flatten(F.transform(of, lambda x: F.transform(F.filter(of, lambda y: meet(x, y)), lambda y: ends(x, y)))))


def _united_in_row(acc: Column, e: Column) -> Column:
    """Nodes (node, label, guard) after the edge e (a, b): its ends' groups are one unless both hold an equal guard."""
    label = lambda end: F.get(F.filter(acc, lambda x: x["node"] == e[end]), F.lit(0))["label"]
    held = lambda of: F.flatten(F.transform(F.filter(acc, lambda x: x["label"] == of), lambda x: x["guard"]))
    united = lambda t: F.transform(acc, lambda x: F.struct(x["node"].alias("node"), F.when(x["label"] == F.greatest(t["a"], t["b"]), F.least(t["a"], t["b"])).otherwise(x["label"]).alias("label"), x["guard"].alias("guard")))
    stay = lambda t: (t["a"] == t["b"]) | F.coalesce(F.arrays_overlap(held(t["a"]), held(t["b"])), F.lit(False))
    return F.get(F.transform(F.array(F.struct(label("a").alias("a"), label("b").alias("b"))), lambda t: F.when(stay(t), acc).otherwise(united(t))), F.lit(0))


def _duplicates_in_rows(facts: DataFrame, alike: Callable[[Column, Column], Column]) -> DataFrame:
    """Duplicate entries of releases whose facts fit in one row each."""
    x = facts.groupBy("release").agg(F.collect_set("entry").alias("entries"), F.collect_list("row").alias("rows"), F.collect_list("file").alias("files"))
    name = lambda y: F.struct(y["track"].alias("track"), y["title"].alias("name"), y["key"].alias("key"), y["plain"].alias("plain"))
    spot = lambda y: F.struct(y["edition"].alias("edition"), y["track"].alias("track"))
    x = x.select(
        "release", "entries", "files", F.filter(F.concat(F.transform("entries", name), F.transform("rows", name)), lambda y: y["name"].isNotNull()).alias("names"),
        F.array_distinct(F.concat(F.transform("rows", spot), F.transform("files", spot))).alias("placed"),
        F.array_distinct(F.transform(F.filter("files", lambda f: f["audio"].isNotNull()), lambda f: F.struct(f["audio"].alias("audio"), f["track"].alias("track")))).alias("sounds"),
    )
    first = lambda e: F.array_min(F.transform(F.filter("files", lambda f: f["track"] == e["track"]), lambda f: F.struct(f["file"], f["seconds"])))["seconds"]
    lengths = F.transform("entries", lambda e: F.struct(e["track"].alias("track"), F.coalesce(e["ms"], first(e) * 1000).alias("ms")))
    keys = lambda e: F.transform(F.filter("names", lambda n: (n["track"] == e["track"]) & (n["key"] != "")), lambda n: F.struct(e["track"].alias("track"), n["key"].alias("key"), e["ms"].alias("ms")))
    x = x.select("release", "files", "names", "placed", "sounds", F.array_distinct(F.flatten(F.transform(lengths, keys))).alias("keyed"))
    long_ = lambda f, g: (F.greatest(f["seconds"], g["seconds"]) <= MASTER_SHARE * F.least(f["seconds"], g["seconds"])) & (F.least(f["seconds"], g["seconds"]) > 0)
    x = x.select(
        "release", "names", "placed", _met("sounds", lambda f, g: (f["track"] < g["track"]) & (f["audio"] == g["audio"])).alias("sound"),
        _met("files", lambda f, g: (f["file"] < g["file"]) & alike(f["file"], g["file"]) & (f["track"] != g["track"]) & long_(f, g)).alias("near"),
        _met("keyed", lambda f, g: (f["track"] < g["track"]) & (f["key"] == g["key"]) & F.coalesce(F.abs(f["ms"] - g["ms"]) <= TITLE_MS, F.lit(True))).alias("titled"),
    )
    ranked = lambda of, rank: F.transform(of, lambda e: F.struct(F.lit(rank).alias("rank"), e["a"].alias("a"), e["b"].alias("b")))
    x = x.select("release", "names", "placed", F.array_sort(F.concat(ranked("sound", 0), ranked(F.array_except("near", "sound"), 1), ranked("titled", 2))).alias("edges"))
    guard = lambda n: F.transform(F.filter("placed", lambda p: p["track"] == n), lambda p: p["edition"])
    nodes = F.transform(F.array_distinct(F.concat("edges.a", "edges.b")), lambda n: F.struct(n.alias("node"), n.alias("label"), guard(n).alias("guard")))
    x = x.select("release", "names", "edges", F.aggregate("edges", nodes, _united_in_row).alias("nodes"))
    group = F.transform(F.filter("nodes", lambda n: n["node"] == n["label"]), lambda n: F.filter("nodes", lambda m: m["label"] == n["node"]))
    x = x.select("release", "names", "edges", F.explode(F.filter(group, lambda g: F.size(g) > 1)).alias("group"))
    mine = lambda t: F.array_contains("group.node", t)
    x = x.select("release", "group", F.filter("names", lambda n: mine(n["track"])).alias("names"), F.filter("edges", lambda e: mine(e["a"]) & mine(e["b"])).alias("edges"))
    order = lambda m: F.struct((F.size(m["guard"]) == 0), F.array_min(m["guard"]), m["node"].alias("node"))
    used = lambda n: F.struct((-F.size(F.filter("names", lambda m: m["name"] == n["name"]))), n["plain"], F.length(n["name"]), n["name"].alias("name"))
    why = F.transform("edges.rank", lambda r: F.element_at(F.array(F.lit("audio"), F.lit("recording"), F.lit("title")), r + 1))
    return x.select(
        "release", F.array_min("group.node").alias("label"), F.array_join(F.transform(F.array_sort(F.transform("group", order)), lambda m: m["node"].cast("string")), ",").alias("tracks"),
        F.array_min(F.transform("names", used))["name"].alias("title"), F.array_join(F.array_sort(F.array_distinct(why)), ",").alias("why"),
    )
