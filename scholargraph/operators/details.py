"""Details of papers: merge of sources, citation contexts, recommendations, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions import ids
from scholargraph.functions.normalize import reconstruct_abstract
from scholargraph.functions.style import citations_per_year, estimated_h_index
from scholargraph.plans.cutpoints import BROADCAST_ROWS, maybe_broadcast, written
from scholargraph.plans.ordering import dense_numbers


def merge_details(s2: DataFrame, openalex: DataFrame, most: int = 20) -> DataFrame:
    """One row per S2-style record, with what its OpenAlex-style work adds.

    Joined by the record's DOI, without resolver and case; of several works with a DOI the first counts.
    Records without a DOI or a work have null there; repeated records stay repeated; null lists are empty.
    """
    doi = ids.extract_doi(F.col("url"))
    paper = s2.select(
        F.col("paperId").alias("id"), F.col("paperId").alias("semantic_scholar_id"), "title", "abstract", "year", F.col("publicationDate").alias("publication_date"),
        F.coalesce(F.transform("authors", lambda a: F.struct(a["authorId"].alias("id"), a["name"].alias("name"), a["url"].alias("url"), F.coalesce(a["affiliations"], F.array().cast("array<string>")).alias("affiliations"))), F.array().cast("array<struct<id:string,name:string,url:string,affiliations:array<string>>>")).alias("authors"),
        "venue", F.coalesce(ids.present(F.col("journal.name")), "venue").alias("journal"), F.col("publicationVenue").alias("publication_venue"),
        F.coalesce("publicationTypes", F.array().cast("array<string>")).alias("publication_types"),
        F.coalesce("citationCount", F.lit(0)).alias("citation_count"), F.coalesce("influentialCitationCount", F.lit(0)).alias("influential_citation_count"),
        F.coalesce(F.size("references"), F.lit(0)).alias("reference_count"), F.coalesce("fieldsOfStudy", F.array().cast("array<string>")).alias("fields_of_study"),
        "url", F.col("openAccessPdf.url").alias("pdf_url"), doi.alias("doi"),
        F.slice("references", 1, most).alias("references"), F.slice("citations", 1, most).alias("citations"), ids.normalized_doi(doi).alias("__doi"),
    ).withColumn("reference_count", F.greatest("reference_count", F.lit(0)))
    concepts = F.transform("concepts", lambda c: F.struct(c["id"].alias("id"), c["display_name"].alias("name"), c["level"].alias("level"), c["score"].alias("score")))
    work = openalex.filter(ids.present(F.col("doi")).isNotNull()).select(
        ids.normalized_doi(F.col("doi")).alias("__doi"), "position", F.col("id").alias("openalex_id"), F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        F.col("best_oa_location.host_venue.url").alias("oa_url"), "apc_paid", concepts.alias("concepts"),
        F.col("sustainable_development_goals").alias("sdg_goals"), F.col("abstract_inverted_index").alias("index"),
    )
    first = work.groupBy("__doi").agg(F.min_by(F.struct("openalex_id", "is_open_access", "oa_url", "apc_paid", "concepts", "sdg_goals", "index"), F.struct("position", "openalex_id")).alias("w"))
    # records without a DOI are dealt out by their ids, as no work is found by "id:..."
    both = paper.withColumn("__doi", F.coalesce("__doi", F.concat(F.lit("id:"), F.coalesce("id", F.lit(""))))).join(first.filter(~F.col("__doi").startswith("id:")), "__doi", "left")
    abstract = F.coalesce(ids.present(F.col("abstract")), reconstruct_abstract(F.col("w.index")), "abstract")
    return both.withColumn("abstract", abstract).select(*[c for c in paper.columns if c != "__doi"], *[F.col(f"w.{c}").alias(c) for c in ("openalex_id", "is_open_access", "oa_url", "apc_paid", "concepts", "sdg_goals")])


def citation_contexts(citations: DataFrame, limit: int = 20) -> DataFrame:
    """(paper_id, citing_paper_id, rank, context, is_influential): the first citing records of each paper.

    Records without contexts have a null context; those without a position are in no list; null cited ids
    are one paper. An empty table gives an empty one.
    """
    rank = F.row_number().over(Window.partitionBy("cited_paper_id").orderBy("cite_position", "citing_paper_id"))
    short = citations.filter(F.col("cite_position") <= limit)  # positions start at 1, so no more can be among the first
    return short.withColumn("rank", rank).filter(F.col("rank") <= limit).select(F.col("cited_paper_id").alias("paper_id"), "citing_paper_id", "rank", F.get("contexts", F.lit(0)).alias("context"), "is_influential")


def influential_citations(citations: DataFrame) -> DataFrame:
    """(paper_id, n_citations, n_influential); a null flag is not influential, null cited ids are one paper."""
    return citations.groupBy(F.col("cited_paper_id").alias("paper_id")).agg(F.count("*").alias("n_citations"), F.count_if("is_influential").alias("n_influential"))


#: Members beyond which a list is heavy: its pairs aren't counted one by one.
HEAVY = 500


#: Papers of a block, pairs beyond which a block is cut into parts, and pairs that a task counts.
BLOCK, BLOCK_PAIRS, COUNTED = 2_048, 8_000_000, 500_000


def _numbered(citations: DataFrame, asked: DataFrame | None) -> tuple[DataFrame, DataFrame, str]:
    """(links, numbers, kind): the links (a, b, oa, ob) by numbers, (id, k, own) of their papers, and the type that members have.

    Papers are numbered in the order of their ids. ``asked`` (id) tells the own ones; if they are few, links that are in
    no list of theirs are left out.
    """
    ends = ["citing_paper_id", "cited_paper_id"]
    links, wanted = written(citations.select(*ends).na.drop(), "links"), None
    if asked is not None:
        wanted = written(asked.select("id").na.drop().distinct(), "asked")
        n = wanted.count()
        if n <= BROADCAST_ROWS:
            for of, p in (ends, ends[::-1]):  # the lists of a citing paper's references, of a cited one's citing papers
                held = written(links.join(maybe_broadcast(wanted.withColumnRenamed("id", p), n), p, "left_semi").select(of).distinct(), "held")
                links = links.join(maybe_broadcast(held.withColumn(f"__{of}", F.lit(True)), held.count()), of, "left")
            links = links.filter(" or ".join(f"__{c}" for c in ends)).select(*ends)
    numbers = dense_numbers(links.select(F.col(ends[0]).alias("id")).union(links.select(ends[1])).distinct(), ["id"], "k")
    own = numbers.withColumn("own", F.lit(True)) if wanted is None else numbers.join(maybe_broadcast(wanted.withColumn("own", F.lit(True)), n), "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    numbers = written(own, "numbers")
    count = numbers.count()
    for c, k, o in ((ends[0], "a", "oa"), (ends[1], "b", "ob")):
        links = links.join(maybe_broadcast(numbers.select(F.col("id").alias(c), F.col("k").alias(k), F.col("own").alias(o)), count), c).drop(c)
    return written(links, "numbered"), numbers, "int" if count < 1 << 30 else "bigint"


def _sides(links: DataFrame) -> list[DataFrame]:
    """(via, p, own) of the lists of references, and of those of citing papers."""
    return [links.select((F.col(of) * 2 + place).alias("via"), F.col(p).alias("p"), F.col(own).alias("own")) for of, p, own, place in (("a", "b", "ob", 0), ("b", "a", "oa", 1))]


def _met(light: list[DataFrame], kind: str, limit: int | None, block: int = BLOCK, most: int = BLOCK_PAIRS) -> DataFrame:
    """(p, q, score, rank): how many of the lists hold both, for own p; its first ``limit`` only, if given (else no rank). Lists are short.

    A list goes whole, as an array, to each block of papers that has own members of it, once; tasks count what their
    papers meet there, so that no pair is moved. Blocks with more than ``most`` pairs are cut by paper.
    """
    packed = [df.groupBy("via").agg(F.collect_set((F.col("p") * 2 + F.col("own").cast("int")).cast(kind)).alias("ms")) for df in light]
    lists = packed[0].union(packed[1]).filter(F.size("ms") > 1).filter(F.exists("ms", lambda m: m % 2 == 1))
    lists = written(lists.select(F.transform("ms", lambda m: F.shiftright(m, 1)).alias("ps"), F.transform(F.filter("ms", lambda m: m % 2 == 1), lambda m: F.shiftright(m, 1)).alias("own")), "lists")
    at = lambda p: F.floor(p / block).cast("int")
    sizes = written(lists.select(F.explode("own").alias("p"), F.size("ps").alias("n")).groupBy(at(F.col("p")).alias("b")).agg(F.sum("n").alias("n")), "sizes")
    large = written(sizes.filter(F.col("n") > most).select("b", F.ceil(F.col("n") / most).cast("int").alias("parts")), "large")
    tasks = -(-(sizes.agg(F.sum("n")).first()[0] or 1) // COUNTED)
    to = lambda b, own: F.struct(b.alias("b"), F.filter(own, lambda p: at(p) == b).alias("own"))
    dealt = lists.select("ps", F.explode(F.transform(F.array_distinct(F.transform("own", at)), lambda b: to(b, F.col("own")))).alias("x")).select("ps", "x.*").withColumn("part", F.lit(0))
    keys = ["b"]  # a constant part would be folded and hide how rows are dealt out
    if not large.isEmpty():
        keys = ["b", "part"]
        cut = dealt.join(F.broadcast(large), "b")  # of some blocks a row each
        part = lambda p: F.pmod(p, F.col("parts")).cast("int")
        each = F.explode(F.transform(F.array_distinct(F.transform("own", part)), lambda i: F.struct(F.filter("own", lambda p: part(p) == i).alias("own"), i.alias("part")))).alias("x")
        dealt = dealt.join(F.broadcast(large), "b", "left_anti").select("b", "part", "ps", "own").union(cut.select("b", "ps", each).select("b", "x.part", "ps", "x.own"))

    # all of a paper is in one task, so its pairs are counted and ranked where the lists are
    each = dealt.repartition(tasks, *keys).select("b", "part", "ps", F.explode("own").alias("p")).select("b", "part", "p", F.explode("ps").alias("q")).filter("p <> q")
    scores = each.groupBy(*keys, "p", "q").agg(F.count("*").alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "p").orderBy(F.desc("score"), "q")))
    kept = scores.withColumn("rank", F.lit(0)) if limit is None else ranked.filter(F.col("rank") <= limit)
    return kept.select(F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), "score", "rank")


def _first_of(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def _with_heavy(heavy: DataFrame, counted: DataFrame, limit: int, part_rows: int) -> DataFrame:
    """(p, q, score) that hold the first ``limit`` of every asked p, from light counts and heavy lists (via, p, own, n).

    What a heavy list adds is bounded by the number of heavy lists that a paper is in, h. A pair with a light
    count can reach p's ``limit``-th only if its count and the smaller h do; only then are its papers' heavy
    lists compared. A pair met in heavy lists alone matters only if h reaches p's ``limit``-th light count, t:

    - one common list: the least ids of each list are enough, as its members all count the same or more;
    - t or more (at least two) common lists: papers of the same heavy lists are one class. A class looks for
      others in its shortest lists only, all but t - 1 of them, as a class without one of these has under t.
      Of every class found the least ids are enough.
    """
    more = limit + 1  # a paper may meet itself
    shortest = F.transform(F.sort_array(F.collect_list(F.struct("n", "via"))), lambda x: x["via"])
    held = written(heavy.groupBy("p", "own").agg(shortest.alias("vias")).withColumn("h", F.size("vias")), "held")
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score")))).filter(F.col("r") == limit)
    tenth = written(ranked.select("p", F.col("score").alias("t")), "tenth")
    h = [held.select(F.col("p").alias(x), F.col("h").alias(f"h{x}"), F.col("vias").alias(f"vias{x}")) for x in "pq"]
    near = counted.join(tenth, "p", "left").withColumn("t", F.coalesce("t", F.lit(0))).join(h[0].drop("viasp"), "p", "left").join(h[1].drop("viasq"), "q", "left")
    near = written(near.filter(F.col("score") + F.least(F.coalesce("hp", F.lit(0)), F.coalesce("hq", F.lit(0))) >= F.col("t")), "near")
    known = near.filter("hp is null or hq is null").select("p", "q", "score")
    looked = near.filter("hp is not null and hq is not null").select("p", "q", "score").join(h[0], "p").join(h[1], "q")
    looked = looked.select("p", "q", (F.col("score") + F.size(F.array_intersect("viasp", "viasq"))).alias("score"))
    # met in heavy lists alone
    asking = held.filter("own").join(tenth, "p", "left").select("p", "vias", F.greatest(F.coalesce("t", F.lit(0)), F.lit(1)).alias("t"), "h").filter("h >= t")
    marked = held.select("p", "vias").join(asking.select("p", "t"), "p", "left")
    classes = written(marked.groupBy("vias").agg(F.min("t").alias("t")).withColumn("cls", F.monotonically_increasing_id()).withColumn("h", F.size("vias")), "classes")
    of = written(marked.join(classes.select("vias", "cls"), "vias").select("p", "cls", F.col("t").isNotNull().alias("asks")), "of")
    firsts = _first_of(of.select("cls", F.col("p").alias("q")), "cls", ["q"], more)
    least = _first_of(heavy.select("via", F.col("p").alias("q")), "via", ["q"], more)
    once = classes.filter("t = 1").select("cls", F.explode("vias").alias("via")).join(least, "via").select("cls", "q", F.lit(1).alias("score"))
    t2 = F.greatest("t", F.lit(2))
    probing = classes.filter(F.col("t").isNotNull() & (F.col("h") >= t2)).select("cls", F.explode(F.slice("vias", F.lit(1), F.col("h") - t2 + 1)).alias("via"))
    indexed = classes.filter("h >= 2").select(F.col("cls").alias("other"), F.explode("vias").alias("via"))
    parts = indexed.groupBy("via").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    left = probing.join(parts, "via").select("via", "cls", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))
    right = indexed.join(parts, "via").select("via", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["via", "part"]).select("cls", "other").distinct()
    sets = [classes.select(F.col("cls").alias(x), F.col("vias").alias(f"s{x}"), t2.alias(f"t{x}")) for x in ("cls", "other")]
    common = pairs.join(sets[0], "cls").join(sets[1], "other").withColumn("score", F.size(F.array_intersect("scls", "sother"))).filter("score >= tcls")
    several = common.select("cls", "other", "score").join(firsts.withColumnRenamed("cls", "other"), "other").select("cls", "q", "score")
    # of what a class finds, its first by score and id
    found = once.union(several).groupBy("cls", "q").agg(F.max("score").alias("score"))
    found = written(_first_of(found, "cls", [F.desc("score"), "q"], more), "found")
    alone = of.filter("asks").join(maybe_broadcast(found, found.count()), "cls").filter("p <> q").select("p", "q", F.col("score").cast("long").alias("score"))
    return known.union(looked).union(alone).groupBy("p", "q").agg(F.max("score").alias("score"))


def recommend(citations: DataFrame, limit: int = 10, asked: DataFrame | None = None, heavy: int = HEAVY, part_rows: int = 1_000) -> DataFrame:
    """(paper_id, recommended_id, score, rank): papers cited together with it, and papers that cite alike.

    The score counts all common citing papers and common references; ties go by id. Rows with a null end
    count for nothing, a pair of papers counts once however often it is repeated, a paper isn't its own
    recommendation; an empty table gives an empty one. ``asked`` (id): only these papers, from the lists
    that hold them. Null or unknown ids have no row.

    Pairs are counted in lists of up to ``heavy`` papers. What longer lists add is bounded and looked up only
    where it can change the first ``limit``; the result is the same for any ``heavy``.
    """
    links, numbers, kind = _numbered(citations, asked)
    light, long = _sides(links), []
    for i, side in enumerate(light):
        sizes = written(side.groupBy("via").agg(F.count("*").alias("n")).filter(F.col("n") > heavy), "heavy")  # repeats may count
        n_heavy = sizes.count()
        if n_heavy:
            long.append(side.join(maybe_broadcast(sizes, n_heavy), "via").distinct())
            light[i] = side.join(maybe_broadcast(sizes.select("via"), n_heavy), "via", "left_anti")
    if not long:
        best = _met(light, kind, limit)
    else:
        counted = written(_met(light, kind, None).select("p", "q", "score"), "counted")
        scores = _with_heavy(written(reduce(DataFrame.union, long), "heavy"), counted, limit, part_rows)
        rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "q"))
        best = scores.withColumn("rank", rank).filter(F.col("rank") <= limit)
    named = [numbers.select(F.col("k").alias(x), F.col("id").alias(c)) for x, c in (("p", "paper_id"), ("q", "recommended_id"))]
    return best.join(named[0], "p").join(named[1], "q").select("paper_id", "recommended_id", "score", "rank")


def paper_metrics(details: DataFrame, as_of_year: int) -> DataFrame:
    """(id, estimated_h_index, citations_per_year, altmetric_score); the last is always 0."""
    return details.select("id", *_metrics(as_of_year))


def _metrics(as_of_year: int) -> list[Column]:
    return [estimated_h_index(F.size("authors")).alias("estimated_h_index"), citations_per_year(F.col("citation_count"), F.col("year"), as_of_year).alias("citations_per_year"), F.lit(0).alias("altmetric_score")]


def paper_details(asked: DataFrame, s2: DataFrame, openalex: DataFrame, citations: DataFrame, as_of_year: int) -> DataFrame:
    """One nested row per asked paper (id) that has a record: details, contexts, recommendations, metrics.

    Ids asked twice or null count once or not at all; parts that a paper lacks are null; an empty table of
    records gives an empty one. What is asked for comes first: only its records, works, citing records and
    the lists that hold it are joined further.
    """
    wanted = written(asked.select("id").na.drop().distinct(), "wanted")
    few = lambda c: maybe_broadcast(wanted.withColumnRenamed("id", c), n)
    n = wanted.count()
    records = written(s2.join(few("paperId"), "paperId", "left_semi"), "records")
    dois = records.select(ids.normalized_doi(ids.extract_doi(F.col("url"))).alias("__doi")).na.drop().distinct()
    works = openalex.join(maybe_broadcast(dois, n), ids.normalized_doi(F.col("doi")) == F.col("__doi"), "left_semi")
    details = merge_details(records, works)
    about = citations.join(few("cited_paper_id"), "cited_paper_id", "left_semi")
    listed = lambda df, *cols: df.groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias("list"))
    contexts = listed(citation_contexts(about), "citing_paper_id", "context", "is_influential").withColumnRenamed("list", "citation_contexts")
    alike = listed(recommend(citations, asked=wanted), "recommended_id", "score").withColumnRenamed("list", "recommendations")
    return details.join(contexts, "id", "left").join(alike, "id", "left").withColumn("metrics", F.struct(*_metrics(as_of_year)))
