"""Word journals as lines, and the media they link to.

The files are read as binary and parsed by the standard library on the workers,
one row per segment between paragraph and soft breaks. A file that cannot be
parsed gives one row with its error, and the others go on.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.functions.text import MEDIA, normalise_path

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
LINES = "file string, line_no int, paragraph int, line string, links array<string>, anchors array<string>, new_par boolean, error string"


def parse(data: bytes) -> Iterator[tuple[int, str, list[str], list[str], bool]]:
    """(paragraph, segment, link targets, their texts, opens a paragraph); links belong to a paragraph's first segment."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        targets: dict[str, str] = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                if r.get("Type", "").endswith("/hyperlink"):
                    targets[r.get("Id", "")] = r.get("Target", "")
    for number, p in enumerate(body.iter(f"{_W}p") if body is not None else ()):
        text, links, anchors = [], [], []
        for node in p.iter():
            if node.tag == f"{_W}t":
                text.append(node.text or "")
            elif node.tag == f"{_W}tab":
                text.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                text.append("\n")
            elif node.tag == f"{_W}hyperlink":
                target = targets.get(node.get(f"{_R}id", ""), "")
                if posixpath.splitext(target.lower())[1].lstrip(".") in MEDIA:
                    links.append(target)
                    anchors.append("".join(t.text or "" for t in node.iter(f"{_W}t")))
        for k, segment in enumerate("".join(text).split("\n")):
            yield number, segment, links if k == 0 else [], anchors if k == 0 else [], k == 0


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all journals of a folder; Word's lock files are passed over, old binary .doc files are errors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.doc*").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").where(~F.startswith("file", F.lit("~$")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"]):
                rows, error = [], None
                try:
                    rows = [(file, k, n, line, links, anchors, new, None) for k, (n, line, links, anchors, new) in enumerate(parse(bytes(content)))]
                except Exception as e:  # noqa: BLE001 - any broken file is a row, not a failed job
                    error = f"ERROR {type(e).__name__}"
                yield pd.DataFrame(rows if error is None else [(file, -1, -1, None, [], [], False, error)], columns=[f.split()[0] for f in LINES.split(", ")])

    return named.mapInPandas(run, LINES)


def _switched(properties, name: str) -> bool:
    node = None if properties is None else properties.find(f"{_W}{name}")
    return node is not None and node.get(f"{_W}val", "true") not in ("0", "false", "off", "none")


def signatures(data: bytes) -> Iterator[tuple[int, str]]:
    """(paragraph, how it is set): its style, bold and italic where all its text is, and a size that all its text has."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names, usual = {}, "?"
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId", "")] = "?" if name is None else name.get(f"{_W}val", "?")
                if style.get(f"{_W}type") == "paragraph" and style.get(f"{_W}default") == "1":
                    usual = names[style.get(f"{_W}styleId", "")]
    for number, p in enumerate(body.iter(f"{_W}p") if body is not None else ()):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        said = [names.get(style.get(f"{_W}val", ""), style.get(f"{_W}val", "?")) if style is not None else usual]
        runs = [r for r in p.iter(f"{_W}r") if "".join(t.text or "" for t in r.iter(f"{_W}t")).strip()]
        marks = [r.find(f"{_W}rPr") for r in runs]
        if runs:
            said += [word for word, tag in (("bold", "b"), ("italic", "i")) if all(_switched(m, tag) for m in marks)]
            sizes = {s.get(f"{_W}val", "") for m in marks if m is not None and (s := m.find(f"{_W}sz")) is not None}
            if len(sizes) == 1:
                said.append(f"{int(sizes.pop()) / 2:g}pt")
        yield number, "+".join(said)


def read_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(file, signature, paragraphs): how the paragraphs of each journal are set; files that cannot be read give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").where(~F.startswith("file", F.lit("~$")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["file"], frame["content"]):
                try:
                    rows += [(file, said) for _, said in signatures(bytes(content))]
                except Exception:  # noqa: BLE001 - read_lines tells of broken files
                    continue
            yield pd.DataFrame(rows, columns=["file", "signature"])

    return named.mapInPandas(run, "file string, signature string").groupBy("file", "signature").agg(F.count("*").alias("paragraphs"))


def photo_links(lines: DataFrame) -> DataFrame:
    """(file, paragraph, paragraph_text, anchor_text, raw_target, path) of every media link."""
    whole = lines.groupBy("file", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "links", "anchors"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    pairs = F.arrays_zip(F.flatten(F.transform("s", lambda x: x["links"])).alias("t"), F.flatten(F.transform("s", lambda x: x["anchors"])).alias("a"))
    return whole.select("file", "paragraph", text.alias("paragraph_text"), F.explode(pairs).alias("l")).select(
        "file", "paragraph", "paragraph_text", F.col("l.a").alias("anchor_text"), F.col("l.t").alias("raw_target"), normalise_path(F.col("l.t")).alias("path")
    )
