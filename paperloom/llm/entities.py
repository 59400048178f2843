"""Problem 2, second part: link all mentions of one party.

Pigeonhole segment join. The distinctive word of each distinct name is cut into k + 1 segments that
stand in an inverted index by length and place; two words within k edits share at least one of them,
shifted by at most k. Every word looks up its shifted substrings, and what it meets is verified with
a banded edit distance. Rare spellings so find the frequent one they are a slip of. Within a family of
names, given names, generations, middle initials and lines of business keep relatives, namesakes and
affiliates apart; a form that leaves this open follows the party its own document names. Aliases and
trade names join parties at the end, unless they are too general.
"""

from __future__ import annotations


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import names as N
from paperloom.session import checkpoint

EDITS = 2
GENERAL = 1 / 3  # an alias of which a party has no more than this share of the mentions does not speak for it
SLIP = 20  # a given name so many times rarer than one a single edit away is a slip of it
TASK_WORDS = 2000  # distinct words a task looks up
FORM = ["kind", "core", "given", "middle", "suffix"]


def mentions(entities: DataFrame, files: DataFrame) -> DataFrame:
    """key, name, doc, aliases of each mention; repeated file rows (same doc_id) add none: the row that
    was loaded last counts. Null and empty names give no mention."""
    last = files.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("file_name", "fact_sheet"), F.struct("loaded_at", "file_name")).alias("f"))
    last = checkpoint(last.select("doc_id", "f.file_name", F.col("f.fact_sheet.parties").alias("parties")))
    of_file = last.where("file_name is not null").groupBy(F.col("file_name").alias("source_file")).agg(F.min("doc_id").alias("doc"))
    typed = entities.select(F.concat(F.lit("E:"), F.col("entity_id").cast("string")).alias("key"), "name", "source_file", "aliases").join(of_file, "source_file", "left")
    parties = last.select("doc_id", F.posexplode("parties").alias("n", "name")).select(
        F.concat(F.lit("P:"), "doc_id", F.lit(":"), F.col("n").cast("string")).alias("key"), "name", F.col("doc_id").alias("doc"), F.array().cast("array<string>").alias("aliases")
    )
    both = typed.select("key", "name", "doc", "aliases").unionByName(parties)
    return both.where(F.col("key").isNotNull() & (F.trim("name") != ""))


def frequent_words(found: DataFrame, share: float = 0.003, least: int = 20) -> tuple[list[str], list[str]]:
    """(given names, business words) that the corpus shows: words in a large share of all names, told
    apart by whether most of these are names of firms. A name of w words adds w to the counts, so no more than
    w / share words can have such a share, however large the corpus is; `least` mentions must prove a word."""
    firm = F.col("name").rlike(r"(?i)\b(inc|incorporated|llc|l\.l\.c|ltd|limited|corp|corporation|l\.?p|partnership|company)\b\.?")
    words = found.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"(\p{L}{3,})"), 1))).alias("w"), firm.alias("firm"), F.monotonically_increasing_id().alias("row"))
    per = words.groupBy("w").agg(F.count("*").alias("n"), F.count_if("firm").alias("f")).where(F.col("n") >= least)
    total = found.count()
    kept = per.where(F.col("n") >= share * total).orderBy(F.desc("n"), "w").collect()
    skip = N.LEGAL | N.TITLES | N.POSTNOMINALS | set(N.SUFFIXES) | set(N.ABBREVIATED) | set(N.NICKNAMES) | N.SMALL | {"liability", "partnership", "trading", "formerly", "known"}
    fresh = [(N.plain(r["w"]), r["f"] / r["n"]) for r in kept if N.plain(r["w"]) not in skip]
    return sorted({w for w, f in fresh if f < 0.2}), sorted({w for w, f in fresh if f >= 0.4})


def read_forms(found: DataFrame, given: list[str], business: list[str]) -> DataFrame:
    """One row for each form: key, doc, role (0 the name, 1 and up what else it says), form fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = N.Reader(given, business)
        for batch in batches:
            rows = []
            for key, name, doc, aliases in zip(batch["key"], batch["name"], batch["doc"], batch["aliases"]):
                read = reader.read(name)
                first = read[0]["kind"] if read else ""
                for alias in [] if aliases is None else aliases:
                    read += [f for f in reader.read(alias or "") if f["kind"] != "acronym" and (f["given"] or first == "acronym")]
                for role, f in enumerate(read):
                    rows.append((key, doc, role, f["kind"], f["core"], f["given"], f["middle"], f["suffix"], f["acr"]))
            yield pd.DataFrame(rows, columns=["key", "doc", "role", *FORM, "acr"])

    schema = "key string, doc string, role int, kind string, core string, given string, middle string, suffix string, acr string"
    return found.select("key", "name", "doc", "aliases").mapInPandas(run, schema)


def right_given(forms: DataFrame) -> DataFrame:
    """given, meant of the given names that are slips of another: rarer by `SLIP` than one of five letters or more
    that is a single edit away, as Mei and Wei, Mary and Mark are names of their own."""
    typed = forms.where("kind = 'person' and length(given) >= 4").groupBy(F.lit("given").alias("kind"), F.lit("").alias("block"), F.col("given").alias("core")).agg(F.count("*").alias("n"))
    typed = checkpoint(typed)
    pairs = similar_words(typed.select("kind", "block", "core"), sounds=False).where("d = 1").select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = typed.select(F.col("core").alias("a"), F.col("n").alias("na"))
    other = typed.select(F.col("core").alias("b"), F.col("n").alias("nb"))
    up = both.join(count, "a").join(other, "b").where((F.length("b") >= 5) & (F.col("nb") >= SLIP * F.col("na")))
    return up.groupBy(F.col("a").alias("given")).agg(F.max_by("b", F.struct("nb", "b")).alias("meant"))


def with_blocks(forms: DataFrame) -> DataFrame:
    """One row for each form and block; choice numbers the blocks of a form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [N.blocks({"kind": k, "given": g}) for k, g in zip(batch["kind"], batch["given"])]
            out = batch.assign(block=blocks, choice=[list(range(len(b))) for b in blocks])
            yield out.explode(["block", "choice"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema)
    return forms.mapInPandas(run, f"{kinds}, block string, choice int")


def segments(word: str, k: int) -> list[tuple[int, str]]:
    """The k + 1 even segments of a word with their places."""
    base, extra = divmod(len(word), k + 1)
    out, at = [], 0
    for n in range(k + 1):
        size = base + (n >= k + 1 - extra)
        out.append((at, word[at : at + size]))
        at += size
    return out


def lookups(word: str, k: int) -> set[tuple[int, int, str]]:
    """(length, number of the segment, substring) under which words within k edits may stand in the index."""
    out = set()
    for length in range(max(k + 1, len(word) - k), len(word) + k + 1):
        for n, (at, seg) in enumerate(segments("x" * length, k)):
            for shift in range(-k, k + 1):
                a = at + shift
                # n edits at most before the segment and k - n after it: farther shifts can't occur for the first hit
                if 0 <= a and a + len(seg) <= len(word) and abs(shift) <= k and abs(shift - (len(word) - length)) <= k:
                    out.add((length, n, word[a : a + len(seg)]))
    return out


def similar_words(nodes: DataFrame, k: int = EDITS, sounds: bool = True, asking: DataFrame | None = None) -> DataFrame:
    """kind, block, a, b, d of the pairs of distinct words within the edits that names of their length allow
    (at most k), as typed or, with `sounds`, as they sound. Words of k letters or fewer match only themselves.

    nodes: kind, block, core, distinct; each pair comes once, with a < b. With `asking`, rows of the same form, the
    pairs are those of a word that asks (a) and another node (b). Words are spread over tasks by hash before they
    are looked up, as each gives some forty substrings; adaptive execution splits substrings that very many words
    share. What meets passes a bounded edit distance in the JVM, twice as wide as swaps count double there, before
    the banded one decides.
    """

    def spellings(core: str) -> dict[str, str]:
        sound = N.skeleton(core) if sounds else core
        return {w: sound for w in (core, sound)}

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(kind, block, f"{len(w)}:{n}:{s}", core, sound) for kind, block, core in zip(batch["kind"], batch["block"], batch["core"]) for w, sound in spellings(core).items() if len(w) > k for n, (_, s) in enumerate(segments(w, k))]
            yield pd.DataFrame(rows, columns=["kind", "block", "seg", "b", "sb"]).drop_duplicates()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(kind, block, f"{length}:{n}:{s}", core, sound) for kind, block, core in zip(batch["kind"], batch["block"], batch["core"]) for w, sound in spellings(core).items() for length, n, s in lookups(w, k)]
            yield pd.DataFrame(rows, columns=["kind", "block", "seg", "a", "sa"]).drop_duplicates()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.copy()
            batch["d"] = [N.close(a, b) if sounds else N.distance(a, b, k) for a, b in zip(batch["a"], batch["b"])]
            yield batch[[d <= min(k, N.edits_allowed(a, b)) for a, b, d in zip(batch["a"], batch["b"], batch["d"])]]

    def spread(words: DataFrame) -> DataFrame:
        return words.repartition(max(1, -(-words.count() // TASK_WORDS)), "core")

    posted = spread(nodes).mapInPandas(index, "kind string, block string, seg string, b string, sb string")
    asked = spread(nodes if asking is None else asking).mapInPandas(look, "kind string, block string, seg string, a string, sa string")
    near = (F.levenshtein("a", "b", 2 * k) >= 0) | (F.levenshtein("sa", "sb", 2 * k) >= 0)
    met = asked.join(posted, ["kind", "block", "seg"]).where((F.col("a") < F.col("b")) if asking is None else (F.col("a") != F.col("b"))).where(near).select("kind", "block", "a", "b").distinct()
    return met.mapInPandas(verify, "kind string, block string, a string, b string, d int")


def roots(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, block, core, root: the frequent spelling each word is a slip of, over as many steps as it takes.

    nodes: kind, block, core, n. A word steps to the nearest, then most frequent, word above it; as steps only
    go up, they end. Each round doubles the steps that are followed.
    """
    both = pairs.unionByName(pairs.select("kind", "block", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    count = nodes.select("kind", "block", F.col("core").alias("a"), F.col("n").alias("na"))
    other = nodes.select("kind", "block", F.col("core").alias("b"), F.col("n").alias("nb"))
    up = both.join(count, ["kind", "block", "a"]).join(other, ["kind", "block", "b"]).where(F.struct("nb", "b") > F.struct("na", "a"))
    step = checkpoint(up.groupBy("kind", "block", F.col("a").alias("core")).agg(F.min_by("b", F.struct("d", -F.col("nb"), "b")).alias("root")))
    while True:
        nxt = step.select("kind", "block", F.col("core").alias("root"), F.col("root").alias("nxt"))
        far = checkpoint(step.join(nxt, ["kind", "block", "root"], "left").select("kind", "block", "core", F.coalesce("nxt", "root").alias("root"), F.col("nxt").isNotNull().alias("moved")))
        step = far.drop("moved")
        if far.where("moved").isEmpty():
            break
    return nodes.select("kind", "block", "core").join(step, ["kind", "block", "core"], "left").withColumn("root", F.coalesce("root", "core"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph (a, b), by alternating large and small
    stars until nothing changes; nodes without edges are not in it. Every round is checkpointed."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = checkpoint(now)
        # the sets differ if their sizes or the sums of their hashes do
        if fingerprint(now) == fingerprint(e):
            break
        e = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def fingerprint(edges: DataFrame) -> tuple:
    """Size of a set of edges and sums of two hashes of each."""
    one, two = (F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))))
    return tuple(edges.agg(F.count("*"), one, two).first())


LABELS = "kind string, block string, core string, given string, middle string, suffix string, labels array<string>, backed boolean"


def resolve_families(families: DataFrame) -> DataFrame:
    """The labels of each distinct form. families: kind, block, root, core, given, middle, suffix, n, own.

    A row of the gathered table is a family: the distinct forms of its names, not their mentions.
    """
    gathered = families.groupBy("kind", "block", "root").agg(F.collect_list(F.struct(*FORM[1:], "n", "own")).alias("forms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, block, root, forms in zip(batch["kind"], batch["block"], batch["root"], batch["forms"]):
                count: dict[tuple[str, str, str], int] = {}
                for f in forms:
                    key = (f["given"], f["middle"], f["suffix"])
                    count[key] = count.get(key, 0) + int(f["n"])
                keys = sorted(count)
                got = dict(zip(keys, N.resolve([(kind, *k, count[k]) for k in keys], {f["given"] for f in forms if f["own"]})))
                for f in forms:
                    labels, backed = got[f["given"], f["middle"], f["suffix"]]
                    rows.append((kind, block, f["core"], f["given"], f["middle"], f["suffix"], [f"{block}|{root}|{x}" for x in labels], backed))
            yield pd.DataFrame(rows, columns=["kind", "block", *FORM[1:], "labels", "backed"])

    return gathered.mapInPandas(run, LABELS)


def whole_lines(labels: DataFrame) -> DataFrame:
    """core, given, labels of the firms whose line of business is named in part: those of the nearest
    spelling of the same name with a line that holds all of theirs and more.

    Firms meet under the words of their line: who names a part of it asks under one of these, who names none of
    it under none, where all are posted.
    """
    firms = checkpoint(labels.where("kind = 'org'").select("core", "given", "labels").distinct())
    line = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    words = line(F.col("given"))
    posted = firms.select(F.lit("org").alias("kind"), F.explode(F.array_append(words, F.lit(""))).alias("block"), "core").distinct()
    asking = firms.select(F.lit("org").alias("kind"), F.coalesce(F.array_min(words), F.lit("")).alias("block"), "core").distinct()
    pairs = similar_words(posted, asking=asking).select("a", "b", "d").distinct()
    cores = firms.select("core").distinct()
    both = pairs.unionByName(cores.select(F.col("core").alias("a"), F.col("core").alias("b"), F.lit(0).alias("d")))
    part, whole = firms.select(F.col("core").alias("a"), "given"), firms.select(F.col("core").alias("b"), F.col("given").alias("more"), "labels")
    wider = (F.col("given") != F.col("more")) & (F.size(F.array_except(line(F.col("given")), line(F.col("more")))) == 0)
    met = checkpoint(part.join(both, "a").join(whole, "b").where(wider))
    partial = met.select(F.col("a").alias("b"), F.col("given").alias("more")).distinct()
    met = met.join(partial, ["b", "more"], "left_anti")
    nearest = met.groupBy("a", "given").agg(F.min("d").alias("d"))
    return met.join(nearest, ["a", "given", "d"]).groupBy(F.col("a").alias("core"), "given").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("whole"))


def link(entities: DataFrame, files: DataFrame) -> DataFrame:
    """key, party of every mention: mentions of one party have the same party."""
    found = mentions(entities, files)
    read = checkpoint(read_forms(found, *frequent_words(found)))
    typed = read.join(right_given(read), "given", "left").withColumn("given", F.when(F.col("kind") == "person", F.coalesce("meant", "given")).otherwise(F.col("given"))).drop("meant")
    forms = checkpoint(with_blocks(typed.select("key", "doc", "role", *FORM, "acr")))
    named = forms.where("kind <> 'acronym'")
    distinct = checkpoint(named.groupBy("kind", "block", *FORM[1:]).agg(F.count("*").alias("n")))
    nodes = distinct.groupBy("kind", "block", "core").agg(F.sum("n").alias("n"))
    root = roots(nodes, checkpoint(similar_words(nodes.select("kind", "block", "core"))))
    # a given name that stands with three surnames or more is no slip of another
    spread = distinct.where("kind = 'person' and length(given) > 2").groupBy("given").agg(F.count_distinct("core").alias("cores")).where("cores >= 3").select("given", F.lit(True).alias("own"))
    families = distinct.join(root, ["kind", "block", "core"]).join(spread, "given", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    labels = checkpoint(resolve_families(families))
    partial = whole_lines(labels).withColumn("kind", F.lit("org"))
    labels = labels.join(partial, ["kind", "core", "given"], "left").withColumn("labels", F.coalesce("whole", "labels")).drop("whole")
    # of several blocks that a nickname allows, those count where a full name stands behind it
    chosen = (
        named.join(labels, ["kind", "block", *FORM[1:]])
        .groupBy("key", "doc", "role", "kind", "acr")
        .agg(F.flatten(F.collect_set(F.when(F.col("backed"), F.col("labels")))).alias("good"), F.min_by("labels", "choice").alias("first"))
        .select("key", "doc", "role", "kind", "acr", F.when(F.size("good") > 0, F.array_distinct("good")).otherwise(F.col("first")).alias("labels"))
    )
    chosen = checkpoint(chosen)
    sure = chosen.where(F.size("labels") == 1).select("key", "doc", "role", "acr", F.col("labels")[0].alias("label"))
    in_doc = sure.where("role = 0 and doc is not null").select("doc", "label").distinct()
    open_ = chosen.where("role = 0 and size(labels) > 1").select("key", "doc", F.explode("labels").alias("label"))
    by_doc = open_.join(in_doc, ["doc", "label"]).groupBy("key").agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n = 1").select("key", "label")
    # an acronym without an alias is the firm of its document with these initials, if there is just one
    short = forms.where("kind = 'acronym' and role = 0").select("key", "doc", "acr")
    firms = sure.where("role = 0 and acr <> '' and doc is not null").select("doc", "acr", "label").distinct()
    by_initials = short.join(firms, ["doc", "acr"]).groupBy("key").agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n = 1").select("key", "label")
    by_alias = short.select("key").join(sure.where("role > 0").select("key", "role", "label"), "key").groupBy("key").agg(F.min_by("label", "role").alias("label"))
    acronyms = by_alias.unionByName(by_initials.join(by_alias, "key", "left_anti"))
    placed = sure.where("role = 0").select("key", "label").unionByName(by_doc).unionByName(acronyms)
    # what leaves open who is meant follows its own alias, if there is just one
    also = checkpoint(sure.where("role > 0").select("key", F.col("label").alias("also")).distinct())
    one_alias = also.groupBy("key").agg(F.min("also").alias("label"), F.count("*").alias("n")).where("n = 1").select("key", "label")
    placed = checkpoint(placed.unionByName(one_alias.join(placed.select("key"), "key", "left_anti")))
    every = checkpoint(found.select("key").distinct().join(placed, "key", "left").select("key", F.coalesce("label", F.concat(F.lit("m|"), "key")).alias("label")))
    # an alias speaks for a party that has a good share of its mentions; one that many parties have is too general
    shared = every.join(also, "key").groupBy("label", "also").agg(F.count("*").alias("n"))
    whole = shared.groupBy("also").agg(F.sum("n").alias("all"))
    edges = shared.where("label <> also").join(whole, "also").where(F.col("n") > F.col("all") * GENERAL).select(F.col("label").alias("a"), F.col("also").alias("b"))
    joined = components(edges).withColumnRenamed("node", "label")
    return every.join(joined, "label", "left").select("key", F.coalesce("component", "label").alias("party"))


def mention_pairs(linked: DataFrame, block: int = 1000) -> DataFrame:
    """key_a < key_b of all pairs of mentions of one party; the listing asks for every pair.

    The mentions of a party are joined to themselves in blocks of about `block`, so that a party with a third of
    all mentions is spread over many tasks.
    """
    size = linked.groupBy("party").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    sized = linked.select("party", "key").distinct().join(size, "party")
    a = sized.select("party", F.col("key").alias("key_a"), F.pmod(F.xxhash64("key"), F.col("salts").cast("bigint")).cast("int").alias("salt"))
    b = sized.select("party", F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["party", "salt"]).where("key_a < key_b").select("key_a", "key_b")


def parties(linked: DataFrame) -> DataFrame:
    """key, party, mentions: each mention with its party and the number of mentions of that."""
    return linked.select("key", "party").distinct().join(linked.select("key", "party").distinct().groupBy("party").agg(F.count("*").alias("mentions")), "party")
