"""Query trees as DataFrame plans.

A tree becomes one row-level predicate and one score expression over the counts of its terms, whatever its
depth: no join per clause. The counts come either from the token array of the row (scan mode), or from one grouped
read of the saved postings of all terms (index mode). Statistics are one row per shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import bm25
from lexispark.plans.query import Bool, Exists, MatchAll, Phrase, Query, Range, Term, scored_terms_of, terms_of, walk
from lexispark.plans.view import KEYS, View


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _times(tokens: Column, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, F.lit(term)))


def _spread(docs: DataFrame) -> DataFrame:
    """Texts over all cores where the table has fewer splits than the cluster has; larger tables stay where they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _in_sequence(tokens: Column, terms: tuple[str, ...]) -> Column:
    """Whether the token array holds the terms one after another; rows that lack one of them aren't walked through."""
    wanted, k = F.array(*[F.lit(t) for t in terms]), len(terms)
    here = F.exists(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda at: F.slice(tokens, at, k).eqNullSafe(wanted))
    return F.when(_all([F.array_contains(tokens, F.lit(t)) for t in dict.fromkeys(terms)]) & (F.size(tokens) >= k), here).otherwise(False)


def _at_steps(positions: list[Column]) -> Column:
    """Whether some position of the first term is followed by one of each next."""
    return F.coalesce(F.exists(positions[0], lambda p: _all([F.array_contains(r, p + n) for n, r in enumerate(positions) if n])), F.lit(False))


class Compiled:
    """Names and expressions for one query on one view."""

    def __init__(self, query: Query, view: View, score: bool = True):
        self.query, self.view = query, view
        has_terms = lambda f: f in view.mapping.fields and view.mapping.fields[f].has_terms
        self.terms = [t for t in terms_of(query, excluded=True) if has_terms(t[0])]
        self.scored = [t for t in scored_terms_of(query) if t in self.terms] if score else []
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.phrases = list(dict.fromkeys(q for q in walk(query) if isinstance(q, Phrase) and len(q.terms) > 1 and all((q.field, t) in self.number for t in q.terms)))
        self.text_fields = list(dict.fromkeys(f for f, _ in self.scored if view.mapping.fields[f].type == "text"))

    def count(self, field: str, term: str) -> Column:
        return F.col(f"_tf{self.number[field, term]}")

    def _length(self, field: str) -> Column:
        return F.col(f"_len_{field}") if field in self.text_fields else F.lit(0)

    def _direct(self, field: str) -> bool:
        """Whether a term is found in the row as it lies, without its token array."""
        view = self.view
        if view.postings is not None or view.is_array(field):
            return False
        spec = view.mapping.fields[field]
        return spec.type != "text" or (spec.analyzer or "standard") == "standard"

    def holds(self, field: str, *terms: str) -> Column:
        """Whether a field holds the terms next to each other, as a predicate that can go down to the scan."""
        if self.view.mapping.fields[field].type != "text":
            return F.col(field).cast("string") == terms[0]
        if any(t == "" or any(c in " \t\n\r" for c in t) for t in terms):
            return F.lit(False)
        each = _all([F.contains(self.view.blanked(field), F.lit(f" {t} ")) for t in dict.fromkeys(terms)])
        return each if len(terms) == 1 else each & F.contains(self.view.padded(field), F.lit(f" {' '.join(terms)} "))

    def term_score(self, field: str, term: str) -> Column:
        i = self.number[field, term]
        total = F.col(f"_sum_{field}") if field in self.text_fields else F.lit(0)
        return bm25.score(self.count(field, term), self._length(field), F.col("_n"), F.col(f"_df{i}"), total)

    def match(self, q: Query) -> Column:
        fields = self.view.mapping.fields
        if isinstance(q, MatchAll):
            return F.lit(True)
        if isinstance(q, Term) and (q.field, q.term) in self.number:
            return self.holds(q.field, q.term) if self._direct(q.field) else self.count(q.field, q.term) > 0
        if isinstance(q, Phrase) and q.terms and all((q.field, t) in self.number for t in q.terms):
            if self._direct(q.field) and (len(q.terms) == 1 or fields[q.field].type == "text"):
                return self.holds(q.field, *q.terms)
            return F.col(f"_phrase{self.phrases.index(q)}") if len(q.terms) > 1 else self.count(q.field, q.terms[0]) > 0
        if isinstance(q, Exists) and q.field in fields:
            if fields[q.field].type == "text":
                if self._direct(q.field):
                    return F.trim(F.translate(F.col(q.field), "\t\n\r", "   ")) != ""
                return self.view.has_tokens(q.field)
            return self.view.value(q.field).isNotNull()
        if isinstance(q, Range) and q.field in fields and fields[q.field].type in ("long", "double"):
            if self.view.is_array(q.field):
                return F.exists(self.view.values(q.field), lambda v: v.between(q.low, q.high))
            return self.view.value(q.field).between(F.lit(q.low), F.lit(q.high))
        if isinstance(q, Bool):
            needed = [self.match(c) for c in q.must + q.filter]
            if not needed and q.should:
                needed = [_any([self.match(c) for c in q.should])]
            if needed:
                return _all(needed + [~F.coalesce(self.match(c), F.lit(False)) for c in q.must_not])
        return F.lit(False)

    def score(self, q: Query) -> Column:
        """The score of a row that matches."""
        if isinstance(q, Term):
            return self.term_score(q.field, q.term) if (q.field, q.term) in self.number else F.lit(0.0)
        if isinstance(q, Phrase):
            return _sum([self.term_score(q.field, t) for t in q.terms if (q.field, t) in self.number])
        if isinstance(q, Bool):
            counted = lambda c: isinstance(c, Term) and (c.field, c.term) in self.scored
            optional = [F.when(self.count(c.field, c.term) > 0 if counted(c) else self.match(c), self.score(c)).otherwise(0.0) for c in q.should]
            return _sum([self.score(c) for c in q.must] + optional)
        return F.lit(1.0)

    def leaves(self) -> DataFrame:
        """Documents with the counts, lengths and phrase flags that the query's expressions refer to."""
        return self._leaves_from_postings() if self.view.postings is not None else self._leaves_from_texts()

    def _leaves_from_texts(self) -> DataFrame:
        view = self.view
        indirect = [t for t in self.terms if not self._direct(t[0])]
        phrases = [q for q in self.phrases if not (self._direct(q.field) and view.mapping.fields[q.field].type == "text")]
        counted = list(dict.fromkeys(self.scored + indirect))
        fields = list(dict.fromkeys([f for f, _ in counted] + [q.field for q in phrases]))
        out = _spread(view.docs).withColumns({f"_tok_{f}": view.tokens(f) for f in fields}) if fields else view.docs
        columns: dict[str, Column] = {}
        for f, term in counted:
            holds, i = F.col(f"_tok_{f}"), self.number[f, term]
            columns[f"_tf{i}"] = _times(holds, term) if view.mapping.fields[f].type == "text" else F.array_contains(holds, F.lit(term)).cast("int")
        for f in self.text_fields:
            columns[f"_len_{f}"] = F.size(F.filter(F.col(f"_tok_{f}"), lambda t: t.isNotNull())) if view.is_array(f) else F.size(f"_tok_{f}")
        for q in phrases:
            columns[f"_phrase{self.phrases.index(q)}"] = _in_sequence(F.col(f"_tok_{q.field}"), q.terms)
        return out.withColumns(columns).drop(*[f"_tok_{f}" for f in fields]) if columns else out

    def _leaves_from_postings(self) -> DataFrame:
        view = self.view
        if not self.terms:
            return view.docs
        wanted = _any([(F.col("field") == f) & F.col("term").isin([t for g, t in self.terms if g == f]) for f in dict.fromkeys(f for f, _ in self.terms)])
        is_term = {i: (F.col("field") == f) & (F.col("term") == t) for (f, t), i in self.number.items()}
        aggregates = [F.coalesce(F.max(F.when(c, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, c in is_term.items()]
        aggregates += [F.max(F.when(F.col("field") == f, F.col("len"))).alias(f"_len_{f}") for f in self.text_fields]
        in_phrase = dict.fromkeys((q.field, t) for q in self.phrases for t in q.terms)
        aggregates += [F.max(F.when(is_term[self.number[t]], F.col("positions"))).alias(f"_pos{self.number[t]}") for t in in_phrase]
        out = view.posted(bool(self.phrases)).filter(wanted).groupBy("_shard", "_doc").agg(*aggregates)
        for i, q in enumerate(self.phrases):
            out = out.withColumn(f"_phrase{i}", _at_steps([F.col(f"_pos{self.number[q.field, t]}") for t in q.terms]))
        out = out.drop(*[f"_pos{self.number[t]}" for t in in_phrase])
        if self._rows_without_terms():
            tf = {f"_tf{i}": F.coalesce(f"_tf{i}", F.lit(0)) for i in self.number.values()}
            phrases = {f"_phrase{i}": F.coalesce(f"_phrase{i}", F.lit(False)) for i in range(len(self.phrases))}
            return view.docs.join(out, ["_shard", "_doc"], "left").withColumns(tf | phrases)
        return out.join(view.docs, ["_shard", "_doc"])

    def _rows_without_terms(self) -> bool:
        """Whether a document that holds none of the terms can match."""

        def can(q: Query) -> bool:
            if isinstance(q, Bool):
                needed = q.must + q.filter
                return all(map(can, needed)) if needed else any(map(can, q.should))
            return isinstance(q, (MatchAll, Exists, Range))

        return can(self.query)

    def statistics(self, leaves: DataFrame) -> DataFrame:
        """One row per shard: live documents, sum of lengths per field, documents per term."""
        view = self.view
        if view.postings is not None:
            n = view.field_stats.groupBy("_shard").agg(
                F.max("n").alias("_n"), *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("sum_len"))), F.lit(0)).alias(f"_sum_{f}") for f in self.text_fields]
            )
            named = {self.number[t]: (F.col("field") == t[0]) & (F.col("term") == t[1]) for t in self.scored}
            df = view.term_stats.filter(_any(list(named.values()))).groupBy("_shard").agg(*[F.max(F.when(c, F.col("df"))).alias(f"_df{i}") for i, c in named.items()])
            return n.join(df, "_shard", "left").fillna(0)
        sums = [F.sum(f"_len_{f}").alias(f"_sum_{f}") for f in self.text_fields]
        has = lambda t: self.holds(*t) if self._direct(t[0]) else self.count(*t) > 0
        dfs = [F.coalesce(F.count_if(has(t)), F.lit(0)).alias(f"_df{self.number[t]}") for t in self.scored]
        return leaves.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n"), *sums, *dfs)

    def matches(self) -> DataFrame:
        """Matching documents with _score, and all columns of the view's documents."""
        leaves = self.leaves()
        found = leaves.filter(self.match(self.query))
        if self.scored:
            # one row per shard, so the hint is bounded by the number of shards
            found = found.join(F.broadcast(self.statistics(leaves)), "_shard")
            score = self.score(self.query)
        else:
            score = self._constant(self.query, found)
        return found.withColumn("_score", score).select(*self.view.docs.columns, "_score")

    def _constant(self, q: Query, found: DataFrame) -> Column:
        return F.lit(0.0) if self.terms and not isinstance(q, Bool) else self.score(q)


def matches(query: Query, view: View, score: bool = True) -> DataFrame:
    if not score:
        compiled = Compiled(query, view, False)
        return compiled.leaves().filter(compiled.match(query)).select(*view.docs.columns).withColumn("_score", F.lit(0.0))
    return Compiled(query, view).matches()


__all__ = ["KEYS", "Compiled", "matches"]
