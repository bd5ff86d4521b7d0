"""The commands of the engine as functions over its catalog tables; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.frontmatter import strip_frontmatter
from docketry.operators import catalog, citations, fusion, persons, segments
from docketry.plans.indexing import Store
from docketry.plans.text_index import TextIndex


def list_laws(laws: DataFrame, category: str | None = None, department: str | None = None, bookmarks: DataFrame | None = None, newest: bool = False, limit: int | None = None) -> DataFrame:
    found = catalog.law_filter(laws, category, department, bookmarks)
    found = catalog.by_date(found, "promulgation_date", "title", "id") if newest else found.orderBy("title", "category", "id")
    return found if limit is None else found.limit(limit)


def search_laws(laws: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return catalog.title_search(laws, query).orderBy("title", "id").limit(limit)


def title_index(spark, root: str, laws: DataFrame) -> TextIndex:
    """A stored index of titles, categories and departments, for ranked searches."""
    index = TextIndex(spark, root, {"title": 1.0, "category": 1.0, "departments": 1.0})
    index.add(laws.select("id", "title", "category", F.array_join("departments", " ").alias("departments")))
    return index


def ranked_titles(index: TextIndex, laws: DataFrame, query: str, category: str | None = None, department: str | None = None, limit: int = 50) -> DataFrame:
    """(id, bm25, score) of laws by rank; without a hit, those that hold the query in their title, with a score of 0."""
    kept = catalog.law_filter(laws, category, department)
    found = index.search(query, limit, among=kept)
    plain = catalog.title_search(kept, query).orderBy("title", "id").limit(limit).select("id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score"))
    return found.unionByName(plain.join(found.limit(1).select(F.lit(True).alias("_some")), how="left_anti"))


def show(documents: DataFrame, id_: str) -> DataFrame:
    """A document's text without its header."""
    return documents.where(F.col("id") == id_).select("id", strip_frontmatter(F.col("raw")).alias("text"))


def list_articles(documents: DataFrame, id_: str) -> DataFrame:
    return segments.extract(documents.where(F.col("id") == id_), "article").orderBy("idx")


def list_precedents(rulings: DataFrame, case_type: str | None = None, court: str | None = None, newest: bool = True, limit: int | None = None) -> DataFrame:
    found = catalog.equal_filter(rulings, case_type=case_type, court_name=court)
    found = catalog.by_date(found, "ruling_date", "case_name", "id") if newest else found.orderBy("case_name", "case_number", "id")
    return found if limit is None else found.limit(limit)


def search_precedents(rulings: DataFrame, query: str, index: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Rulings by name or number; if none is found and the query has the shape of a name, those that name the person."""
    import re

    found = catalog.title_search(rulings, query, ("case_name", "case_number")).orderBy("case_name", "id").limit(limit)
    if index is None or not re.fullmatch("[가-힯ᄀ-ᇿ㄰-㆏]{2,4}", query):
        return found
    named = rulings.join(persons.search(index, query).select("id").distinct(), "id", "left_semi").orderBy("case_name", "id").limit(20)
    none = found.limit(1).select(F.lit(True).alias("_some"))
    return found.unionByName(named.join(none, how="left_anti"))


def precedent_sections(documents: DataFrame, id_: str) -> DataFrame:
    return segments.extract(documents.where(F.col("id") == id_), "section").orderBy("idx")


def precedent_laws(documents: DataFrame, laws: DataFrame, id_: str) -> DataFrame:
    """The statutes that a ruling cites, with the laws that they are matched to."""
    refs = citations.extract_statutes(documents.where(F.col("id") == id_))
    return refs.join(citations.match_laws(refs, laws.select("title")), "law_name", "left").orderBy("pos")


def precedent_persons(documents: DataFrame, id_: str) -> DataFrame:
    return persons.extract(documents.where(F.col("id") == id_)).orderBy("pos")


def search_person(index: DataFrame, rulings: DataFrame, name: str, role: str | None = None, case_type: str | None = None, court: str | None = None, limit: int = 20) -> DataFrame:
    kept = catalog.equal_filter(rulings, case_type=case_type, court_name=court)
    return persons.search(index, name, role).join(kept, "id").orderBy("id", "role").limit(limit)


def law_precedents(index: DataFrame, rulings: DataFrame, law: str, article: str | None = None, limit: int = 20) -> DataFrame:
    """Rulings that cite a law, from the citation index: all of them, not only those whose name holds the law's."""
    return citations.rulings_for(index, rulings, law, article).orderBy("id").limit(limit)


def similar(rulings: DataFrame, documents: DataFrame, query: str, n: int = 10, limit: int = 20) -> DataFrame:
    """Laws that the best rulings for a query cite, with the path of each law's document."""
    found = fusion.similar(rulings, query, n, limit)
    titles = citations.first_by_title(documents).select(F.col("title").alias("law_name"), F.col("path").alias("law_doc_path"))
    return found.join(titles, "law_name", "left").orderBy(F.desc("cite_count"), "law_name", "article")


def staged_counts(rulings: DataFrame) -> DataFrame:
    """(case_type, court_level, n)."""
    return rulings.groupBy("case_type", "court_level").agg(F.count("*").alias("n"))


def status(store: Store) -> DataFrame:
    """(collection, n, n_contents, last_batch) of the active documents."""
    return store.documents().groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("n_contents"), F.max("batch").alias("last_batch"))


#: Fixed names of the collections, in the order in which they are indexed.
COLLECTIONS = ("laws", "precedents", "admrules", "ordinances")


def sync(store: Store, files: dict[str, DataFrame], batch: int) -> DataFrame:
    """Brings the collections that files (path, text, size, mtime) are given for up to date, in one batch; what is no longer among
    a collection's files has gone. Returns (collection, changed, gone)."""
    unknown = set(files) - set(COLLECTIONS)
    if unknown or not files:
        raise ValueError(f"collections are {', '.join(COLLECTIONS)}")
    rows = [files[c].select(F.lit(c).alias("collection"), "path", "text", "size", "mtime") for c in COLLECTIONS if c in files]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    done = store.index(every, batch, tombstones=True)
    return done.groupBy("collection").agg(F.count_if("active").alias("changed"), F.count_if(~F.col("active")).alias("gone"))


def index_all(store: Store, files: dict[str, DataFrame], batch: int) -> DataFrame:
    """sync() of all four collections."""
    if set(files) != set(COLLECTIONS):
        raise ValueError(f"files are needed for {', '.join(COLLECTIONS)}")
    return sync(store, files, batch)


def reset(store: Store) -> None:
    """Removes what was indexed; the files stay."""
    store.reset()


def search(store: Store, query: str, collection: str | None = None, semantic: bool = True, limit: int = 20) -> DataFrame:
    """Documents for a query, by text and, if wanted, by meaning."""
    return store.hybrid(query, collection, limit) if semantic else store.search(query, collection, limit).select("id", "score")
