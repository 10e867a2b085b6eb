"""Tables kept between runs, and the sinks."""

from __future__ import annotations

import html
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tags that are written as plain ones.
PLAIN_TAGS = {"padv": "adv", "padj": "adj", "psubst": "subst"}


def _complete(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was written completely, else ``build()`` written there (O-18 to O-20, O-22)."""
    if not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_lines(df: DataFrame, column: str, order: list[str], path: str, single: bool = False) -> None:
    """Text lines in order (O-23, O-35): range-partitioned and sorted, so the parts' order is the rows'; ``single`` gives one file."""
    rows = df.orderBy(*order).select(F.coalesce(column, F.lit("")).alias("value"))
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header (O-31, O-33 with ``sep='$'``)."""
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def write_training_rows(df: DataFrame, path: str, predicate: str, frame: str) -> None:
    """Gzipped CSV of training rows below a folder per predicate and frame (O-30); folders are named by hashes, ``mapping`` tells
    them apart. Rows of one frame are shuffled together first, so each frame has few files."""
    named = df.withColumn("predicate_key", F.substring(F.md5(predicate), 1, 16)).withColumn("frame_key", F.substring(F.md5(frame), 1, 16))
    named.repartition("predicate_key", "frame_key").write.mode("overwrite").partitionBy("predicate_key", "frame_key").option("header", "true").option("compression", "gzip").csv(path + "/rows")
    named.select("predicate_key", "frame_key", predicate, frame).distinct().write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path + "/mapping")


def libsvm_line(label, features):
    """``label index:value ...`` of an array column, zeros left out, indices from 0 (O-32)."""
    pairs = F.transform(features, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(F.filter(pairs, lambda p: p["x"] != 0), lambda p: F.concat_ws(":", p["i"].cast("string"), p["x"].cast("string"))), " "))


def feature_lines(tokens: DataFrame, columns: list[str], label: str, sentence: str, position: str) -> DataFrame:
    """Feature lines with the gold label last (O-26) and a blank line after each sentence; fails on white space within a value."""
    values = [F.col(c) for c in columns] + [F.coalesce(label, F.lit("_"))]
    checked = [F.when(v.rlike(r"\s"), F.raise_error(F.concat(F.lit("white space in "), v)).cast("string")).otherwise(v) for v in values]
    last = F.lead(position).over(Window.partitionBy(sentence).orderBy(position)).isNull()
    line = F.concat(F.concat_ws("\t", *checked), F.when(last, "\n").otherwise(""))
    return tokens.select(sentence, position, line.alias("line"))


def pp_lines(tokens: DataFrame, decided: DataFrame) -> DataFrame:
    """Attachment rows with the words from five before to two after the preposition as context (O-29)."""
    words = tokens.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "orth"))), lambda x: x["orth"]).alias("orths"))
    joined = decided.join(words, "sent_id")
    start = F.greatest(F.col("word_no") - 5, F.lit(0))
    context = F.array_join(F.slice("orths", start + 1, F.col("word_no") + 3 - start), " ")
    return joined.select("sent_id", "word_no", F.concat_ws("\t", "verb", "noun", "prep", "case_", "decision", context).alias("line"))


def plain_tag(ctag: str) -> str:
    for a, b in PLAIN_TAGS.items():
        ctag = ctag.replace(a, b)
    return ctag


CCL = (['<?xml version="1.0" encoding="UTF-8"?>', '<!DOCTYPE chunkList SYSTEM "ccl.dtd">', "<chunkList>", ' <chunk id="ch1" type="p">'], [" </chunk>", "</chunkList>"])
XCES = (['<?xml version="1.0" encoding="UTF-8"?>', "<cesAna>", " <chunkList>"], [" </chunkList>", "</cesAna>"])


def _ccl_sentence(sid: str, words: list[dict]) -> list[str]:
    out = [f'  <sentence id="{html.escape(sid)}">']
    for w in words:
        out += ["   <tok>", f"    <orth>{escape(w['orth'])}</orth>", f'    <lex disamb="1"><base>{escape(w["base"])}</base><ctag>{escape(plain_tag(w["ctag"]))}</ctag></lex>', "   </tok>"]
        if w.get("nps"):
            out.append("   <ns/>")
    return [*out, "  </sentence>"]


def _xces_sentence(_: str, words: list[dict]) -> list[str]:
    out = ['  <chunk type="s">']
    for w in words:
        out.append(f'   <tok><orth>{escape(w["orth"])}</orth><lex disamb="1"><base>{escape(w["base"])}</base><ctag>{escape(w["ctag"])}</ctag></lex></tok>')
        if w.get("nps"):
            out.append("   <ns/>")
    return [*out, "  </chunk>"]


def ccl_xml(sentences: list[tuple[str, list[dict]]]) -> str:
    """A chunked file without chunks from (id, words) (O-27)."""
    return "\n".join([*CCL[0], *[x for sid, words in sentences for x in _ccl_sentence(sid, words)], *CCL[1], ""])


def xces_xml(sentences: list[list[dict]]) -> str:
    """An XCES file of words with their chosen reading (O-28); marks are escaped the usual way."""
    return "\n".join([*XCES[0], *[x for words in sentences for x in _xces_sentence("", words)], *XCES[1], ""])


def _write_files(df: DataFrame, path: str, frame: tuple[list[str], list[str]], sentence) -> None:
    """One file per partition, written line by line: no more than a batch of sentences is held. Null words, forms, lemmas and tags are written empty; a null sentence has no words."""

    def plain(w) -> dict:
        w = w.asDict() if hasattr(w, "asDict") else dict(w or {})
        return {k: w.get(k) or "" for k in ("orth", "base", "ctag")} | {"nps": bool(w.get("nps"))}

    def run(batches):
        import pandas as pd

        begun = False
        for b in batches:
            lines = [] if begun or not len(b) else list(frame[0])
            begun = begun or bool(len(b))
            for sid, words in zip(b["sent_id"], b["words"]):
                lines += sentence(str(sid), [plain(w) for w in (() if words is None else words)])
            yield pd.DataFrame({"value": lines}, dtype=object)
        if begun:
            yield pd.DataFrame({"value": frame[1]})

    df.select("sent_id", "words").mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_ccl(df: DataFrame, path: str) -> None:
    """Sentences (sent_id, words) as chunked files (O-27)."""
    _write_files(df, path, CCL, _ccl_sentence)


def write_xces(df: DataFrame, path: str) -> None:
    """Sentences (sent_id, words) as XCES files (O-28)."""
    _write_files(df, path, XCES, _xces_sentence)


def html_report(rows: list[dict], columns: list[str], good: str | None = None) -> str:
    """An HTML table of a bounded sample of rows; cells of ``good`` are green or red (O-34)."""
    cell = lambda c, v: f'<td style="background:{"#cfc" if v else "#fcc"}">{html.escape(str(v))}</td>' if c == good else f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>"
    return "<table>\n" + head + "\n" + "\n".join("<tr>" + "".join(cell(c, r.get(c)) for c in columns) + "</tr>" for r in rows) + "\n</table>\n"
