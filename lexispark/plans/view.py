"""What a query reads: documents with their shard, order and field expressions, from a raw table or a saved index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import analysis, routing
from lexispark.mapping import Mapping

KEYS = ("_shard", "_doc", "_id")


@dataclass(frozen=True)
class View:
    """``docs`` has _shard, _doc (order within the shard), _id and one column per mapped field.

    A column may be a scalar or an array of values. Terms come from every value, the value for sorting, ranges
    and aggregations is the last one. With ``postings`` (blocks, see sources/store.py) the terms are read from there instead of
    from the texts; ``dead`` (_shard, _doc) are documents that the blocks still hold and ``docs`` doesn't.
    """

    docs: DataFrame
    mapping: Mapping
    shards: int = 1
    postings: DataFrame | None = None
    field_stats: DataFrame | None = None
    dead: DataFrame | None = None

    def posted(self, positions: bool = True) -> DataFrame:
        """(_shard, field, term, _doc, tf, len, positions), one row per live document and term. Filters on field and term reach
        the scan of the blocks, and positions are read only when asked for."""
        names = {"docs": "_doc", "tfs": "tf", "lens": "len"} | ({"positions": "positions"} if positions else {})
        rows = self.postings.select("_shard", "field", "term", F.inline(F.arrays_zip(*names))).withColumnsRenamed(names)
        return rows.join(self.dead, ["_shard", "_doc"], "left_anti") if self.dead is not None else rows

    @property
    def term_stats(self) -> DataFrame:
        """(_shard, field, term, df) of live documents."""
        by = ["_shard", "field", "term"]
        if self.dead is not None:
            return self.posted(False).groupBy(*by).agg(F.count("*").alias("df"))
        return self.postings.groupBy(*by).agg(F.sum(F.size("docs")).alias("df"))

    @classmethod
    def of_table(cls, table: DataFrame, key: str, properties: dict, shards: int = 1) -> View:
        """A table as it lies, its key as id and order. With several shards rows are routed by the id's hash."""
        mapping = Mapping.of(properties)
        doc_id = F.col(key).cast("string")
        fields = [F.col(n) for n in mapping.fields]
        docs = table.select(routing.shard(doc_id, shards).alias("_shard"), F.col(key).cast("long").alias("_doc"), doc_id.alias("_id"), *fields)
        return cls(docs, mapping, shards)

    def in_one_shard(self) -> View:
        """The same documents with collection-wide statistics."""
        return replace(self, docs=self.docs.withColumn("_shard", F.lit(0)), shards=1, postings=None, field_stats=None, dead=None)

    def is_array(self, field: str) -> bool:
        return dict(self.docs.dtypes)[field].startswith("array<")

    def values(self, field: str) -> Column:
        """All values of the field as an array, empty where there are none."""
        kind = "double" if self.mapping.fields[field].type == "double" else "bigint" if self.mapping.fields[field].type == "long" else "string"
        if self.is_array(field):
            return F.coalesce(F.col(field), F.array()).cast(f"array<{kind}>")
        return F.when(F.col(field).isNotNull(), F.array(F.col(field).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))

    def value(self, field: str) -> Column:
        """The last value of the field; null where there is none. Empty strings count as none."""
        spec = self.mapping.fields[field]
        if self.is_array(field):
            last = F.when(F.size(field) > 0, F.element_at(field, -1))
        else:
            last = F.col(field)
        if spec.type == "long":
            return last if dict(self.docs.dtypes)[field] in ("bigint", "int") else last.cast("long")
        if spec.type == "double":
            return last.cast("double")
        text = last.cast("string")
        return F.when(text != "", text)

    def tokens(self, field: str) -> Column:
        """Token array of a text field, or the terms of a keyword or boolean field."""
        spec = self.mapping.fields[field]
        if spec.type != "text":
            return self.values(field)
        analyzer = analysis.get(spec.analyzer)
        if self.is_array(field):
            return analysis.value_tokens(self.values(field), analyzer)
        return F.coalesce(analyzer.tokens(F.col(field)), F.array().cast("array<string>"))

    def has_tokens(self, field: str) -> Column:
        """Whether a text field has a token, from its stored number of tokens where there is one."""
        stored = f"_tokens_{field}"
        return F.col(stored) > 0 if stored in self.docs.columns else F.size(F.filter(self.tokens(field), lambda t: t.isNotNull())) > 0

    def blanked(self, field: str) -> Column:
        """A text of the standard analyzer with blanks around every token, so that a token is a substring of it."""
        text = analysis.lower_case(F.col(field))
        for white in "\t\n\r":
            text = F.replace(text, F.lit(white), F.lit(" "))
        return F.concat(F.lit(" "), text, F.lit(" "))

    def padded(self, field: str) -> Column:
        """The same with exactly one blank between two tokens, so that a phrase is a substring of it."""
        return F.regexp_replace(self.blanked(field), " +", " ")
