"""Readers of whole files: chunked corpora (CCL), treebank trees, word vectors, lexical networks."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.slots import QUESTION_WORDS
from frameloom.functions.attachment import VERB_POS

SENTENCE = """source string, sent_id string, text string, words array<struct<orth:string,base:string,ctag:string,nps:boolean>>,
    chunks array<struct<number:int,type:string,head:int,words:array<int>>>"""
ARGUMENTS = "array<struct<pred:struct<left_ix:int,right_ix:int>,args:array<struct<span:struct<left_ix:int,right_ix:int>,argument_type:string,syntactic_head:int,semantic_head:int>>>>"


def sentence_text(words: list[dict]) -> str:
    return "".join(w["orth"] + ("" if w["nps"] else " ") for w in words).strip()


def parse_ccl(xml: bytes) -> list[dict]:
    """Sentences of a chunked file (O-02, O-03). Tokens without a chosen reading are dropped, and chunks number the tokens
    kept; of a chunk's heads the first counts. A file that is not XML gives none."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out = []
    for node in root.iter("sentence"):
        words: list[dict] = []
        chunks: dict[tuple[str, int], dict] = {}
        for item in node:
            if item.tag == "ns":
                if words:
                    words[-1]["nps"] = True
            elif item.tag == "tok":
                lex = next((x for x in item.iter("lex") if x.get("disamb") == "1"), None)
                if lex is None:
                    continue
                at = len(words)
                words.append({"orth": item.findtext("orth") or "", "base": lex.findtext("base") or "", "ctag": lex.findtext("ctag") or "", "nps": False})
                for ann in item.iter("ann"):
                    number = int((ann.text or "0").strip() or 0)
                    if number:
                        c = chunks.setdefault((ann.get("chan"), number), {"number": number, "type": ann.get("chan"), "head": None, "words": []})
                        c["words"].append(at)
                        if ann.get("head") == "1" and c["head"] is None:
                            c["head"] = at
        if words:
            out.append({"sent_id": node.get("id"), "text": sentence_text(words), "words": words, "chunks": list(chunks.values())})
    return out


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_ccl(spark: SparkSession, path: str, glob: str = "*.chunked") -> DataFrame:
    """Sentences of all chunked files below ``path`` (O-01, O-02)."""

    def run(batches):
        for b in batches:
            rows = [{"source": p, **s} for p, c in zip(b["path"], b["content"]) for s in parse_ccl(c)]
            yield pd.DataFrame(rows, columns=["source", "sent_id", "text", "words", "chunks"])

    return _files(spark, path, glob).mapInPandas(run, SENTENCE)


def chunks_of(sentences: DataFrame) -> DataFrame:
    """Chunk rows (O-04, O-05): source, sent_id, number, type, head, words."""
    return sentences.select("source", "sent_id", F.explode("chunks").alias("c")).select("source", "sent_id", "c.number", "c.type", "c.head", "c.words")


# --- treebank ----------------------------------------------------------------------------------------------------


class Tree:
    """A treebank tree: chosen nodes by number, their chosen children with the head marks, and features."""

    def __init__(self, root: ElementTree.Element):
        self.root = root
        self.nodes = {n.get("nid"): n for n in root.iter("node") if n.get("chosen") == "true"}
        self.children: dict[str, list[tuple[str, bool]]] = {}
        used = set()
        for nid, n in self.nodes.items():
            kids = next((c for c in n.findall("children") if c.get("chosen") == "true"), None)
            self.children[nid] = [(c.get("nid"), c.get("head") == "true") for c in kids.findall("child") if c.get("nid") in self.nodes] if kids is not None else []
            used |= {k for k, _ in self.children[nid]}
        self.tops = [nid for nid in self.nodes if nid not in used]

    def category(self, nid: str) -> str:
        return self.nodes[nid].findtext("nonterminal/category") or ""

    def feature(self, nid: str, kind: str) -> str:
        return "".join(f.text or "" for f in self.nodes[nid].iter("f") if f.get("type") == kind)

    def span(self, nid: str) -> tuple[int, int]:
        return int(self.nodes[nid].get("from")), int(self.nodes[nid].get("to"))

    def head(self, nid: str) -> str | None:
        """The terminal reached by head children only."""
        while nid is not None and self.nodes[nid].find("terminal") is None:
            nid = next((c for c, h in self.children[nid] if h), None)
        return nid

    def head_pos(self, nid: str) -> str:
        h = self.head(nid)
        return self.feature(h, "tag").split(":")[0] if h else "xxx"


def _cleaned(text: str) -> str:
    return re.sub(r"[ \t\n]", "", text)


#: Kinds of phrases by category of the node.
_PHRASES = {
    "fno": lambda t, n: f"np({t.feature(n, 'przypadek')})",
    "fps": lambda t, n: "advp",
    "fpt": lambda t, n: f"adjp({t.feature(n, 'przypadek')})",
    "fpm": lambda t, n: f"prepnp({t.feature(n, 'przyim')},{t.feature(n, 'przypadek')})",
    "fpmpt": lambda t, n: f"prepadj({t.feature(n, 'przyim')},{t.feature(n, 'przypadek')})",
    "fzd": lambda t, n: f"sentp({t.feature(n, 'tfz')})",
}
_NO_HEAD = ("conj", "interp")


def _phrases(tree: Tree, nid: str, span, kind: str | None) -> list[tuple[str, tuple[int, int], int | None]]:
    """Phrases at or below a node: a phrase with a proper head stands for itself, a coordination for the phrases in it."""
    category = tree.category(nid)
    if category in _PHRASES and not tree.feature(nid, "przypadek").startswith("["):
        pos = tree.head_pos(nid)
        if pos not in _NO_HEAD and tree.head(nid):
            return [(kind or _PHRASES[category](tree, nid), span or tree.span(nid), tree.span(tree.head(nid))[0])]
    return [x for c, _ in tree.children[nid] for x in _phrases(tree, c, span, kind)]


def _argument(tree: Tree, nid: str) -> list[dict]:
    kind, span = tree.feature(nid, "tfw"), tree.span(nid)
    below = lambda s, k: [x for c, _ in tree.children[nid] for x in _phrases(tree, c, s, k)]
    head = tree.head(nid)
    rows = [(kind, span, tree.span(head)[0] if head else None)]
    if kind == "advp":
        inner = below(span, None)
        rows = [(inner[0][0] if inner else kind, *rows[0][1:])]
    elif tree.head_pos(nid) in _NO_HEAD:
        rows = below(None, kind) or rows
    return [{"span": {"left_ix": s[0], "right_ix": s[1]}, "argument_type": _cleaned(k), "syntactic_head": h, "semantic_head": None} for k, s, h in rows]


def _collect(tree: Tree, top: str, wanted: str, stop: tuple[str, ...]) -> list[str]:
    """Nodes of a category below ``top``, not below one another nor below a stop."""
    out, todo = [], [c for c, _ in reversed(tree.children[top])]
    while todo:
        nid = todo.pop()
        if tree.category(nid) == wanted:
            out.append(nid)
        elif tree.category(nid) not in stop:
            todo += [c for c, _ in reversed(tree.children[nid])]
    return out


def _clauses(tree: Tree) -> list[tuple[str, tuple[int, int] | None]]:
    """Clauses and infinitive arguments with their predicate's span."""
    out = []
    for nid in tree.nodes:
        category = tree.category(nid)
        if category == "zdanie":
            at: str | None = nid
            while at is not None and tree.category(at) != "ff":
                at = next((c for c, h in tree.children[at] if h and tree.category(c) != "zdanie"), None)
            out.append((nid, tree.span(at) if at else None))
        elif category == "fw" and tree.feature(nid, "tfw").startswith("infp"):
            head = tree.head(nid)
            out.append((nid, tree.span(head) if head else None))
    return out


def _structures(pairs) -> list[dict]:
    grouped: dict[tuple[int, int], list[dict]] = {}
    for span, args in pairs:
        grouped.setdefault(span, []).extend(args)
    return [{"pred": {"left_ix": s[0], "right_ix": s[1]}, "args": a} for s, a in grouped.items()]


def parse_tree(xml: str) -> dict | None:
    """A treebank sentence (O-06, O-90): text, words, argument structures of clauses and infinitives, and free phrases.
    None unless the answer is a full tree."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    if "".join(x.get("type", "") for x in root.iter("base-answer")) != "FULL":
        return None
    tree = Tree(root)
    terminals = sorted((int(n.get("from")), n) for n in tree.nodes.values() if n.find("terminal") is not None)
    words = [{"orth": n.findtext("terminal/orth") or "", "base": n.findtext("terminal/base") or "", "ctag": "".join(f.text or "" for f in n.iter("f") if f.get("type") == "tag"), "nps": any(x.get("nps") == "true" for x in n.iter())} for _, n in terminals]
    required, free = [], []
    for nid, pred in _clauses(tree):
        if pred is None:
            continue
        required.append((pred, [a for fw in _collect(tree, nid, "fw", ("fl", "zdanie", "formarzecz", "formaprzym")) for a in _argument(tree, fw)]))
        adjuncts = [x for fl in _collect(tree, nid, "fl", ("zdanie",)) for c, _ in tree.children[fl] for x in _phrases(tree, c, tree.span(fl), None)]
        if adjuncts:
            free.append((pred, [{"span": {"left_ix": s[0], "right_ix": s[1]}, "argument_type": k, "syntactic_head": h, "semantic_head": None} for k, s, h in adjuncts]))
    return {"text": root.findtext("text") or "-- missing text --", "words": words, "argument_structures": _structures(required), "free_phrases": _structures(free)}


def read_treebank(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Full trees below ``path`` as sentences (O-06, O-90a-c)."""

    def run(batches):
        for b in batches:
            rows = [{"source": p, **s} for p, c in zip(b["path"], b["content"]) if (s := parse_tree(c.decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["source", "text", "words", "argument_structures", "free_phrases"])

    return _files(spark, path, glob).mapInPandas(run, f"source string, text string, words array<struct<orth:string,base:string,ctag:string,nps:boolean>>, argument_structures {ARGUMENTS}, free_phrases {ARGUMENTS}")


def parse_rection(tag: str) -> list[str]:
    """Sorted elements of a rection tag ``[a,b(c,d)]`` (O-90d)."""
    return sorted(x.strip() for x in re.findall(r"[^,(]*(?:\([^)]*\))?", tag.strip()[1:-1]) if x.strip())


def move_question_heads(sentence: dict) -> dict:
    """Heads of ``sentp(pz)`` that are verbs or nouns move to the question word on the left; other arguments there go (O-90e)."""
    words = sentence["words"]
    asks = lambda w: w["base"].lower() in QUESTION_WORDS or w["orth"].lower() in QUESTION_WORDS

    def moved(a: dict) -> dict:
        at = a["syntactic_head"] if a["syntactic_head"] is not None else len(words) - 1
        if a["argument_type"] != "sentp(pz)" or not (words[at]["ctag"].startswith(tuple(VERB_POS)) or words[at]["ctag"].startswith("subst")):
            return a
        to = next((i for i in range(at, -1, -1) if asks(words[i])), None)
        return a if to is None else {**a, "syntactic_head": to}

    parts = {k: [{**e, "args": [moved(a) for a in e["args"]]} for e in sentence[k]] for k in ("argument_structures", "free_phrases")}
    taken = {a["syntactic_head"] for es in parts.values() for e in es for a in e["args"] if a["argument_type"] == "sentp(pz)"} - {None}
    keep = lambda a: a["argument_type"] == "sentp(pz)" or a["syntactic_head"] not in taken
    return {**sentence, **{k: [{**e, "args": [a for a in e["args"] if keep(a)]} for e in es] for k, es in parts.items()}}


# --- vectors and networks ----------------------------------------------------------------------------------------


def parse_vectors(data: bytes) -> tuple[list[str], np.ndarray]:
    """Words and L2-normalised vectors of a binary file: ``count dim``, then word, blank and little-endian floats (O-09).
    All-zero vectors stay zero."""
    end = data.index(b"\n")
    count, dim = map(int, data[:end].split())
    words, vectors, at = [], np.zeros((count, dim), np.float32), end + 1
    for i in range(count):
        stop = data.index(b" ", at)
        words.append(data[at:stop].decode("utf-8", "replace").strip())
        vectors[i] = np.frombuffer(data, "<f4", dim, stop + 1)
        at = stop + 1 + 4 * dim
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return words, np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def read_vectors(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """(word, vec) of binary vector files, one task per file; convert once to Parquet for large ones."""

    def run(batches):
        for b in batches:
            for c in b["content"]:
                words, vectors = parse_vectors(c)
                for a in range(0, len(words), 10_000):
                    yield pd.DataFrame({"word": words[a : a + 10_000], "vec": list(vectors[a : a + 10_000])})

    return _files(spark, path, glob).select("content").mapInPandas(run, "word string, vec array<float>")


def read_wordnet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lexical network (O-10) as tables: ``units`` (unit_id, name, variant, pos, domain), ``synsets`` (synset_id, unit_id), ``hypernyms``
    (child_id, parent_id), the relations of type 11. The XML source reads each kind of element as rows of its own."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    units = xml("lexical-unit", "_id long, _name string, _variant int, _pos string, _domain string")
    synsets = xml("synset", "_id long, `unit-id` array<long>")
    relations = xml("synsetrelations", "_relation int, _parent long, _child long")
    return {
        "units": units.select(F.col("_id").alias("unit_id"), F.col("_name").alias("name"), F.col("_variant").alias("variant"), F.col("_pos").alias("pos"), F.col("_domain").alias("domain")),
        "synsets": synsets.select(F.col("_id").alias("synset_id"), F.explode("unit-id").alias("unit_id")),
        "hypernyms": relations.where("_relation = 11").select(F.col("_child").alias("child_id"), F.col("_parent").alias("parent_id")),
    }
