"""Index lookups on a store: each is a filter, a projection and, where it can repeat, a distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.joins import intersection
from tripleweave.sources.store import Store


class AccessPaths:
    def __init__(self, store: Store):
        self.store = store

    def subjects_of(self, p: str) -> DataFrame:
        return self.store.triples(p=p).select("s").distinct()

    def objects_of(self, p: str) -> DataFrame:
        return self.store.triples(p=p).select("o").distinct()

    def predicates_of_subject(self, s: str) -> DataFrame:
        return self.store.triples(s=s).select("p").distinct()

    def predicates_of_object(self, o: str) -> DataFrame:
        return self.store.triples(o=o).select("p").distinct()

    def objects(self, s: str, p: str) -> DataFrame:
        return self.store.triples(s=s, p=p).select("o")

    def subjects(self, o: str, p: str) -> DataFrame:
        return self.store.triples(o=o, p=p).select("s")

    def predicates(self, s: str, o: str) -> DataFrame:
        return self.store.triples(s=s, o=o).select("p")

    def neighbours(self, s: str) -> DataFrame:
        return self.store.triples(s=s).select("o").distinct()

    def referrers(self, o: str) -> DataFrame:
        return self.store.triples(o=o).select("s").distinct()

    def subjects_with_all(self, pairs: list[tuple[str, str]]) -> DataFrame:
        """Subjects that have each of these (predicate, object) pairs: the intersection of the pairs' candidate sets."""
        return intersection([self.subjects(o, p) for p, o in pairs], "s")

    def n_subjects_of(self, p: str) -> int:
        return sum(r.n_subjects for r in self.store.statistics([p]).collect())

    def n_objects_of(self, p: str) -> int:
        return sum(r.n_objects for r in self.store.statistics([p]).collect())

    def degree(self, s: str | None = None, p: str | None = None, o: str | None = None) -> int:
        """How many triples have these constants."""
        return self.store.triples(s, p, o).count()

    def characteristic_set(self, entity: str, of_objects: bool = False) -> DataFrame:
        """``predicates`` of a subject (or object), by its set's id."""
        name = "cs_o" if of_objects else "cs_s"
        return self.store.sets_of(entity, of_objects).join(self.store.table(f"{name}_sets"), "cs").select("predicates")

    def id_of(self, term: str) -> int | None:
        return self.store.ids_of([term]).get(term)

    def term_of(self, number: int) -> str | None:
        row = self.store.table("dict").where(F.col("id") == number).first()
        return row.term if row else None
