"""Generated, minified, vendored and data files among source files.

Every file is lexed; its tokens become three Re-Pair grammars. That of the token kinds shows structure: a grammar far smaller
than those of hand-written files of the same length reuses its rules too much for a person. That of the literals, in short
pieces, shows blobs and tables: they hardly compress. Those of the spelt tokens of each top-level item give rules that are the
same in every copy of the item, wherever it stands; rules that occur in other repositories show copied code.

What the grammars can't show is who wrote a file: most generated files here are built like hand-written ones, and a copy looks
like its original. Plain notes of generators and vendoring tools, the names such tools give files, and the directories that
third-party code is kept in count by themselves; a note that may mean something else counts only where a grammar agrees.
Minified code shows in its missing spaces. Only files that are about to be called foreign are parsed, to tell invalid ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinloom.llm.arrow import batches_of, columns
from pinloom.llm.parsing import SOURCE, Lexed, accepted, language_of, lexed, spread
from pinloom.llm.repair import induce
from pinloom.plans.sizing import checkpointed

LITERALS = frozenset(["NUM", "STR", "BYTES", "CHAR", "TPL", "REGEX", "FEND"])
#: Kinds without which a file holds nothing but values.
CODE = frozenset(["import", "from", "use", "class", "def", "func", "fn", "function", "struct", "impl", "if", "for", "while", "return", "type", "=>", "lambda"])
#: Signs that formatted code puts a space or a line end behind.
SPACED = frozenset([",", ";", "=", "==", "{", "}", "=>", "+", "-", "*", "<", ">", "&&", "||", "?", ":", "+=", "^=", "==="])
#: Part of those signs that is followed by space, up to which code is minified, and the least number of them.
TIGHT_PART, TIGHT_SIGNS = 0.2, 30
#: Characters of a piece of a literal.
PIECE = 4
#: Symbols a piece in the grammar of the literals, from which they count as incompressible.
INCOMPRESSIBLE = 0.5
#: A bare table: at least so many values, and so large a part of all words; a blob: so large a part of all characters.
TABLE_VALUES, TABLE_PART, BLOB_PART, BLOB_CHARS = 4, 0.5, 0.99, 200
#: Rules that count for sharing span at least so many tokens.
SHARED_SPAN = 12
#: Part of a file's tokens in rules shared with other repositories, from which it is a copy of something.
COPIED_PART = 0.5
#: Size of the structure's grammar (symbols a token) that one in twenty hand-written files of n tokens stays below: A * (n / 150) ** B,
#: fitted once to 1,500 files of Python's standard library and 3,400 hand-written ones of the test data.
EXPECTED_A, EXPECTED_B = 0.40, -0.33
#: Parts of that size below which structure alone, or with a vague note, shows a generator.
REPEATED, SUSPECT = 0.6, 0.85

#: How generators and vendoring tools mark files, at the beginning of a line or sentence.
_THING = r"(?:(?:this|the)\s+)?(?:(?:source\s+)?(?:file|code|module)\s+)?(?:(?:is|was|has\s+been)\s+)?"
GENERATED = re.compile(
    rf"^(?:{_THING}(?:auto-?\s?generated|automatically\s+generated|machine[- ](?:made|generated|written)|generated\s+(?:by|from|with|using|automatically)|(?:produced|created|written|built)\s+(?:automatically|by\s+(?:a\s+|the\s+)?(?:program|tool|script|generator)))\b"
    r"|<?auto-?generated\b|output\s+of\s+\S+(?:\s+\S+)?\s+for\s+\S+|(?:changes|edits)\s+made\s+(?:by\s+hand\s+)?(?:are|will\s+be)\s+(?:lost|overwritten)\b)"
    r"|@generated\b|(?:^|[.,;:!\-]\s*)do\s+not\s+(?:edit|modify|change)\s*(?:$|[.,;!]|this\s+file|it\b|by\s+hand|manually|directly)",
    re.I | re.M,
)
VENDORED = re.compile(
    rf"^(?:{_THING}(?:vendored|bundled\s+copy|taken\s+(?:unchanged|verbatim|over)\s+from|cop(?:y|ied)\s+(?:unchanged|verbatim)\s+from|imported\s+(?:unchanged|as\s+is)\s+from)\b|upstream\s?:\s?\S+|local\s+edits\s+are\s+overwritten\b)"
    r"|\(third[- ]party,|\bimported\s+as\s+is\b|\bfixes\s+go\s+upstream\b",
    re.I | re.M,
)
BANNER = re.compile(r"^/\*!\s*\S+ v?\d+(?:\.\d+)+", re.M)
#: Words that may mean the same but may also speak of something else.
VAGUE_GENERATED = re.compile(r"\bauto-?generated\b|\bmachine[- ](?:made|generated|written)\b|\bgenerated (?:by|from|with|using|automatically|on)\b|\bdo not (?:edit|modify|change)\b", re.I)
VAGUE_VENDORED = re.compile(r"\bvendored\b|\bthird[- ]party\b|\bupstream\b|\bbundled\b|\bcop(?:y|ied) (?:of|from)\b|\btaken from\b", re.I)
DENIED = re.compile(r"\b(?:not|never|no longer|isn't|aren't|wasn't)\b[^.]{0,20}\b(?:auto-?|machine[- ])?(?:generated|vendored|third[- ]party|made|produced)", re.I)
#: Directories that third-party code is kept in, and names that generators give their files.
DIRECTORIES = r"(?i)(^|/)(_?vendor(ed)?|third[_-]?party|node_modules|bower_components|jspm_packages|externals?|extern|deps|site-packages|godeps)/"
NAMES = r"(?i)((\.gen|\.generated|_gen|_generated|\.pb|_pb2?|\.g)\.[a-z]+$|(^|/)zz_generated)"


def notes(file: Lexed, language: str) -> str:
    """The comments before the first code and after the last, without their marks; in Python also a docstring there."""
    text, tokens = file.text, file.tokens
    first = tokens.offsets[0] if tokens.kinds[0] != "$" else len(text)
    last = max((o + len(t) for o, t in zip(tokens.offsets[-6:], tokens.texts[-6:]) if t.strip()), default=0)
    out = []
    for a, b in tokens.comments:
        # a comment that stands alone in one of the first lines counts too: the package clause may stand before it
        if b <= first or a >= last or (not text[text.rfind("\n", 0, a) + 1 : a].strip() and text.count("\n", 0, a) < 4):
            out.append(text[a:b])
    if language == "python" and tokens.kinds[0] == "STR":
        out.append(tokens.texts[0])
    return "\n".join(out)


_MARKS = re.compile(r"^[ \t]*(?:///?!?|/\*+!?|\*+/?|#+!?|[rRuUbB]?(?:\"\"\"|'''|\"|'))[ \t]*", re.M)


def _hash(text: str) -> int:
    if (h := _HASHES.get(text)) is None:
        h = xxhash.xxh3_64_intdigest(text)
        if len(_HASHES) < 200_000:
            _HASHES[text] = h
    return h


_HASHES: dict[str, int] = {}


def token_hashes(kinds: list[str]) -> np.ndarray:
    found = list(map(_HASHES.get, kinds))
    if None in found:
        found = list(map(_hash, kinds))
    return np.array(found, np.uint64)


_LINE_END = re.compile("\n")
_NO_ITEM = frozenset([")", "]", "}", "NEWLINE", "DEDENT", "INDENT", "$", ";"])


def items(file: Lexed) -> list[tuple[int, int]]:
    """The token spans of the top-level items: each begins at the left margin, closing brackets aside."""
    tokens = file.tokens
    margin = {0, *(m.end() for m in _LINE_END.finditer(file.text))}
    starts = [i for i, (o, k) in enumerate(zip(tokens.offsets, tokens.kinds)) if o in margin and k not in _NO_ITEM]
    return list(zip(starts, [*starts[1:], len(tokens.kinds)]))


def tightness(tokens) -> tuple[int, int]:
    """(signs that formatted code puts space behind, those that have it)."""
    signs = spaced = 0
    offsets = tokens.offsets
    for i, k in enumerate(tokens.kinds[:-1]):
        if k in SPACED:
            signs += 1
            spaced += offsets[i + 1] > offsets[i] + len(k)
    return signs, spaced


def literal_facts(tokens) -> tuple[int, int, int]:
    """Characters in literals, blanks aside; values (literals of one line); all words."""
    literals = [t for k, t in zip(tokens.kinds, tokens.texts) if k in LITERALS]
    words = len(literals) + sum(k[0].isalpha() and k not in LITERALS and k not in _LAYOUT for k in tokens.kinds)
    return sum(map(len, "".join(literals).split())), sum("\n" not in t for t in literals), words


def literal_pieces(tokens) -> list[str]:
    """The literals in short pieces."""
    pieces: list[str] = []
    for k, t in zip(tokens.kinds, tokens.texts):
        if k in LITERALS:
            if len(t) <= PIECE:
                pieces.append(t)
            else:
                pieces += [t[a : a + PIECE] for a in range(0, len(t), PIECE)]
    return pieces


_LAYOUT = frozenset(["NEWLINE", "INDENT", "DEDENT"])


def is_code(kinds: list[str]) -> bool:
    """Whether there is a function, type, import, call or statement."""
    return not CODE.isdisjoint(kinds) or any(b == "(" and a in ("NAME", ")") for a, b in zip(kinds, kinds[1:]))


def expected_size(tokens: int) -> float:
    return min(1.0, EXPECTED_A * (max(tokens, 1) / 150) ** EXPECTED_B)


def classify(evidence: dict) -> tuple[str, str]:
    """(class, what decided): minified, data, vendored, generated, or hand-written if nothing speaks against it.

    ``evidence`` has tokens, structure, literal (sizes of the grammars), code, values, words, literal_part, literal_chars, signs,
    spaced, directory, name, note, and shared (part of the tokens in rules that other repositories have).
    """
    e = evidence
    said = DENIED.sub(" ", e["note"])
    ratio = e["structure"] / expected_size(e["tokens"])
    dense, repeated = (e["literal"] or 0.0) >= INCOMPRESSIBLE, ratio < REPEATED
    table = not e["code"] and e["values"] >= TABLE_VALUES and e["values"] >= TABLE_PART * e["words"]
    if dense and e["literal_part"] >= BLOB_PART and e["literal_chars"] >= BLOB_CHARS or table and (dense or repeated):
        return "data", "literals"
    if e["signs"] >= TIGHT_SIGNS and e["spaced"] <= TIGHT_PART * e["signs"]:
        return "minified", "spacing"
    if e["directory"]:
        return "vendored", "directory"
    if VENDORED.search(said) or BANNER.search(e["raw_note"]):
        return "vendored", "note"
    if e["shared"] >= COPIED_PART and VAGUE_VENDORED.search(said):
        return "vendored", "shared rules"
    if repeated:
        return "generated", "reused rules"
    if GENERATED.search(said):
        return "generated", "note"
    if e["name"]:
        return "generated", "name"
    if ratio < SUSPECT and VAGUE_GENERATED.search(said):
        return "generated", "reused rules"
    return "hand-written", ""


#: Evidence of each file, beside its rules.
EVIDENCE = [("tokens", pa.int32()), ("structure", pa.float64()), ("literal", pa.float64()), ("code", pa.bool_()), ("values", pa.int32()), ("words", pa.int32()), ("literal_part", pa.float64())]
EVIDENCE += [("literal_chars", pa.int32()), ("signs", pa.int32()), ("spaced", pa.int32()), ("directory", pa.bool_()), ("name", pa.bool_())]
_KEYS = [n for n, _ in EVIDENCE]
FILES = pa.schema([("_id", pa.int64()), ("slug", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("class", pa.string()), ("decided_by", pa.string()), ("if_copied", pa.string()), *EVIDENCE, ("rules", pa.list_(pa.int64())), ("spans", pa.list_(pa.int32()))])
FILES_DDL = (
    "_id long, slug string, language string, valid boolean, class string, decided_by string, if_copied string, tokens int, structure double, literal double, code boolean, values int, words int, "
    "literal_part double, literal_chars int, signs int, spaced int, directory boolean, name boolean, rules array<long>, spans array<int>"
)
#: Tokens whose grammars are induced together.
BATCH_TOKENS = 400_000


def _item_rules(files: list[Lexed]) -> list[tuple[list[int], list[int]]]:
    """For each file its rules, the start rules of its items' grammars, with the tokens they span."""
    sequences: list[np.ndarray] = []
    owner: list[int] = []
    for f, file in enumerate(files):
        hashes = token_hashes(file.tokens.texts)
        for a, b in items(file):
            if b - a >= SHARED_SPAN:
                sequences.append(hashes[a:b])
                owner.append(f)
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in files]
    names = induce(sequences).start_rule.view(np.int64).tolist() if sequences else []
    for f, name, s in zip(owner, names, sequences):
        out[f][0].append(name)
        out[f][1].append(len(s))
    return out


def facts(df: DataFrame, key: str, path: str, content: str, slug: Column, judge_all: bool) -> DataFrame:
    """A row for each source file with its evidence and rules, its class as far as the file itself shows it, and the class it has if it
    turns out to be a copy. Files that look hand-written are parsed only with ``judge_all``; else their ``valid`` is null."""

    def flush(held: list[tuple]) -> Iterator[tuple]:
        files = [h[5] for h in held]
        structures = induce([token_hashes(f.tokens.kinds) for f in files]).size().tolist()
        counts = [literal_facts(f.tokens) for f in files]
        parts = [c[0] / max(sum(map(len, "".join(f.tokens.texts).split())), 1) for c, f in zip(counts, files)]
        code = [is_code(f.tokens.kinds) for f in files]
        # only a file without code, or of almost nothing but literals, can be data; others need no grammar of their literals
        literal = {f: None for f in range(len(files))}
        bare = [f for f in literal if not code[f] or parts[f] >= BLOB_PART]
        literal.update(zip(bare, induce([token_hashes(literal_pieces(files[f].tokens)) for f in bare]).size().tolist() if bare else []))
        rules = _item_rules(files)
        for f, ((i, s, language, directory, name, file), structure, (chars, values, words), (own, spans)) in enumerate(zip(held, structures, counts, rules)):
            raw = notes(file, language)
            signs, spaced = tightness(file.tokens)
            tokens = len(file.tokens.kinds)
            found = (tokens, structure, literal[f], code[f], values, words, parts[f], chars, signs, spaced, directory, name)
            evidence = dict(zip(_KEYS, found)) | {"note": _MARKS.sub("", raw), "raw_note": raw, "shared": 0.0}
            kind, why = classify(evidence)
            copied, _ = classify(evidence | {"shared": 1.0})
            valid = accepted(language, file) if judge_all or copied != "hand-written" else None
            if valid is False:
                kind, why, copied = "invalid", "", "invalid"
            yield (i, s, language, valid, kind, why, copied, *found, own, spans)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i, s, language, directory, name, data in columns(batch, "_id", "_s", "_l", "_v", "_n", "_c"):
                file = lexed(language, data)
                if file is None or "BAD" in file.tokens.kinds[-2:]:
                    yield (i, s, language, False, "invalid", "", "invalid", *[None] * len(_KEYS), [], [])
                    continue
                held.append((i, s, language, directory, name, file))
                size += len(file.tokens.kinds)
                if size > BATCH_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), FILES, 5_000)

    named = F.col(f"`{path}`")
    source = df.select(
        F.col(f"`{key}`").cast("long").alias("_id"), slug.alias("_s"), language_of(named, SOURCE).alias("_l"), named.rlike(DIRECTORIES).alias("_v"), named.rlike(NAMES).alias("_n"), F.col(f"`{content}`").alias("_c")
    )
    return spread(source.where("_l IS NOT NULL AND _c IS NOT NULL"), "_id").mapInArrow(run, FILES_DDL)


def shared_parts(found: DataFrame, wanted: Column) -> DataFrame:
    """(_id, rules, shared, part) of the files ``wanted``: how many of their rules other repositories have, and the part of their tokens in these.

    A rule's repositories are counted by their least and greatest name, so that a rule that all files hold is settled by a
    combining aggregate. Only rules of wanted files are looked up.
    """
    every = found.select("_id", "slug", "tokens", wanted.alias("_w"), F.explode(F.arrays_zip("rules", "spans")).alias("r")).select("_id", "slug", "tokens", "_w", F.col("r.rules").alias("rule"), F.col("r.spans").alias("span"))
    several = every.groupBy("rule").agg(F.min("slug").alias("a"), F.max("slug").alias("b"), F.bool_or("_w").alias("_any")).where("a <> b AND _any").select("rule", F.lit(1).alias("_s"))
    mine = every.where("_w")
    part = F.sum(F.when(F.col("_s") == 1, F.col("span")).otherwise(0)) / F.first("tokens")
    return mine.join(several, "rule", "left").groupBy("_id").agg(F.count("*").cast("int").alias("rules"), F.count("_s").cast("int").alias("shared"), F.least(F.lit(1.0), part).alias("shared_part"))


def foreign_files(df: DataFrame, key: str = "file_id", path: str = "path", content: str = "content", slug: str | None = "slug", judge_all: bool = True) -> DataFrame:
    """The class of each source file: generated, minified, vendored, data, hand-written, or invalid if it doesn't parse.

    Columns: ``key``, slug, language, valid, class, decided_by (literals, spacing, directory, note, name, reused rules or shared
    rules), tokens, structure and literal (symbols of the Re-Pair grammars per token and piece, the latter only
    for files that may be data), shared_part (part of the tokens
    in rules shared with other repositories, for files whose class depends on it). Files that claim no source language, and null
    contents and paths, give no row; an empty file is hand-written where its language allows it. Repeated rows count once; other
    columns are ignored. Without ``judge_all`` files that look hand-written aren't parsed, and their ``valid`` is null.
    """
    owner = F.col(f"`{slug}`") if slug else F.lit("")
    found = checkpointed(facts(df, key, path, content, owner, judge_all))
    open_files = F.col("if_copied") != F.col("class")
    parts = shared_parts(found, open_files)
    copied = (F.col("shared_part") >= COPIED_PART) & open_files
    joined = found.drop("rules", "spans").join(parts.select("_id", "shared_part"), "_id", "left")
    judged = joined.withColumn("decided_by", F.when(copied, "shared rules").otherwise(F.col("decided_by"))).withColumn("class", F.when(copied, F.col("if_copied")).otherwise(F.col("class")))
    return judged.select(F.col("_id").alias(key), "slug", "language", "valid", "class", "decided_by", "tokens", "structure", "literal", "shared_part").distinct()


def shared_rules(df: DataFrame, key: str = "file_id", path: str = "path", content: str = "content", slug: str = "slug") -> DataFrame:
    """For each valid source file its class by its own evidence, its rules, how many of them other repositories have, and the part of its tokens in these.

    Columns: ``key``, class, rules, shared, shared_part. Repeated rows count once; nulls as in ``foreign_files``.
    """
    found = checkpointed(facts(df, key, path, content, F.col(f"`{slug}`"), True).where("valid").dropDuplicates(["_id"]))
    parts = shared_parts(found, F.lit(True))
    out = found.select(F.col("_id"), "class").join(parts, "_id", "left").fillna(0, ["rules", "shared"]).fillna(0.0, ["shared_part"])
    return out.withColumnRenamed("_id", key)
