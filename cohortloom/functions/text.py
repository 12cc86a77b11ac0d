"""Scalar expressions on ids, names, file stems and transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks that count as white space in source files (wider than the JVM's own \s).
BLANKS = "".join(
    map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029])
) + "".join(map(chr, [0x202F, 0x205F, 0x3000]))
# View marks in file stems (front, up, left, right).
VIEW_MARKS = "正|仰|左|右"
# Hesitation characters.
FILLERS = "啊嗯呃哦"
# Punctuation that separates spoken tokens.
PUNCTUATION = "，。！？；：、,.!?;:"
# Letters read for digits, and the digits they stand for.
LOOKALIKE_LETTERS = "OILSB"
LOOKALIKE_DIGITS = "01158"
# The prompt every speaker reads aloud.
READING_PROMPT = (
    "啊。阿姨。一零一二三四五六七八九十。跑步，说话，唱歌，微笑，鼓掌。"
    "画图，数数，流星，书本，我出去买菜。"
    "我去地里摘玫瑰，今天的菜卖完了。"
    "住在附近的李红带来了新鲜的蘑菇，明明坐上了刚到的货车，手放不进办公室里的桌子里。"
    "北风和太阳争论谁的本领大。"
    "他们看见有一个人。"
    "身上穿着一件厚衣服。"
    "谁能叫他把衣服脱下来。"
    "就算谁有本领。"
    "北风拼命地吹啊吹啊。"
    "他吹得越厉害。"
    "那个人把衣服裹得越紧。"
    "太阳出来一晒。"
    "那个人马上把衣服脱下来了。"
    "所以北风不得不承认。"
    "太阳比他有本领。"
)

# Fixed patterns.
_BLANK_CLASS = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STEM = rf"^(.+?)-?({VIEW_MARKS})[{_BLANK_CLASS}]*-?[{_BLANK_CLASS}]*(\d+)$"
_ID_PREFIX = r"^(\d{3}[A-Z]{2}|[A-Z]{1,3}\d{3})"
_NAME_RUN = r"([\x{4e00}-\x{9fff}]{2,5})"
_NOT_WORD = r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def norm_id(text: Column) -> Column:
    return F.upper(strip(text))


def norm_name(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_BLANK_CLASS}]+", "")


def clean_name(text: Column) -> Column:
    """Last run of 2-5 ideographs once marks, counters and id prefixes are gone; '' when none is left."""
    t = F.regexp_replace(text, "[（(]有重名[）)]", "")
    t = norm_name(t)
    t = F.regexp_replace(t, r"^.*?\+\d*", "")
    t = F.regexp_replace(t, r"^\d+", "")
    t = F.regexp_replace(t, r"(?i)^[A-Z]{1,3}\d{3}", "")
    runs = F.regexp_extract_all(F.btrim(t, F.lit("_-")), F.lit(_NAME_RUN), F.lit(1))
    return F.when(F.size(runs) > 0, F.element_at(runs, -1)).otherwise(F.lit(""))


def name_candidates(text: Column) -> Column:
    """Ordered distinct names found in a `|`, `;` or `,` separated text."""
    pieces = F.split(F.coalesce(text, F.lit("")), "[|;,]")
    return F.array_distinct(F.filter(F.transform(pieces, clean_name), lambda x: x != ""))


def sample_name(entity_id: Column, stem: Column) -> Column:
    """Name in the folder name, otherwise the one in the file stem without its view mark."""
    from_id = clean_name(entity_id)
    bare = F.regexp_replace(stem, rf"-({VIEW_MARKS})-?\d+$", "")
    bare = F.regexp_replace(bare, rf"({VIEW_MARKS})-?\d+$", "")
    return F.when(from_id != "", from_id).otherwise(clean_name(bare))


def digits_for_lookalikes(entity_id: Column) -> Column:
    return F.translate(entity_id, LOOKALIKE_LETTERS, LOOKALIKE_DIGITS)


def sequence_for_entity(stem: Column, entity_id: Column) -> Column:
    """`<entity>-?<digits>` as an int, otherwise NULL."""
    tail = F.substring(stem, F.length(entity_id) + 1, F.length(stem))
    digits = F.regexp_extract(tail, r"^-?(\d+)$", 1)
    return F.when(F.startswith(stem, entity_id), digits.try_cast("int"))


def parse_stem(stem: Column) -> Column:
    """File stem to struct(entity_id, view, sequence); all NULL when the shape is unknown."""
    raw = strip(F.regexp_extract(stem, _STEM, 1))
    prefix = F.regexp_extract(raw, _ID_PREFIX, 1)
    known = stem.rlike(_STEM)
    return F.struct(
        F.when(known, F.when(prefix != "", prefix).otherwise(raw)).alias("entity_id"),
        F.when(known, F.regexp_extract(stem, _STEM, 2)).alias("view"),
        F.when(known, F.regexp_extract(stem, _STEM, 3).try_cast("int")).alias("sequence"),
    )


def file_stem(path: Column) -> Column:
    """Last path part without its last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]+)$", 1))


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def id_from_filename(name: Column) -> Column:
    return strip(F.split_part(file_stem(name), F.lit("_"), F.lit(1)))


def norm_text(text: Column) -> Column:
    """Ideographs, ASCII letters and digits only."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _NOT_WORD, "")


def _is_kept(codes: np.ndarray) -> np.ndarray:
    """What `norm_text` keeps, on code points."""
    folded = codes | 32
    return ((codes >= 0x4E00) & (codes <= 0x9FFF)) | ((codes >= 48) & (codes <= 57)) | ((folded >= 97) & (folded <= 122) & (codes < 128))


_SEPARATORS = np.array(sorted(map(ord, PUNCTUATION + BLANKS)), dtype=np.uint32)
#: Texts and characters that are looked at together.
_PART_TEXTS = 512
_PART_CHARS = 1 << 20


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lengths, code points) of runs of whole texts."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _PART_CHARS or k + 1 - start == _PART_TEXTS or k + 1 == len(texts):
            some = texts[start : k + 1]
            yield np.array([len(x) for x in some]), np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
            start, size = k + 1, 0


_COUNTS = ("kept", "distinct", "tokens", "fillers", "repeats")


def character_counts(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One row per text: kept characters, distinct ones, tokens, fillers, and kept characters equal to the next."""
    n = len(lengths)
    rows = np.repeat(np.arange(n), lengths)
    mask = _is_kept(codes)
    body, at = codes[mask], rows[mask]
    cut = np.isin(codes, _SEPARATORS)
    first = np.ones(len(codes), bool)
    first[1:] = cut[:-1] | (rows[1:] != rows[:-1])
    alike = (body[1:] == body[:-1]) & (at[1:] == at[:-1])
    seen, place = np.unique(body, return_inverse=True)
    present = np.zeros((n, len(seen)), bool)
    present[at, place] = True
    fillers = np.isin(body, np.array([ord(c) for c in FILLERS], dtype=np.uint32))
    count = lambda where: np.bincount(where, minlength=n)
    return np.stack([count(at), present.sum(axis=1), count(rows[~cut & first]), count(at[fillers]), count(at[:-1][alike])], axis=1).astype(float)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _COUNTS]))
def _character_counts(text: pd.Series) -> pd.DataFrame:
    found = [character_counts(*part) for part in _parts(text.tolist())]
    return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, len(_COUNTS))), columns=list(_COUNTS))


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series) -> pd.Series:
    out = []
    for lengths, codes in _parts(text.tolist()):
        mask = _is_kept(codes)
        body = codes[mask].tobytes().decode("utf-32-le")
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(lengths)), lengths)[mask], minlength=len(lengths)))]).tolist()
        out += [body[a:b] for a, b in zip(ends, ends[1:])]
    return pd.Series(out, dtype="object")


def text_profile(text: Column, sentence_count: Column, total_ms: Column) -> dict[str, Column]:
    """Eleven transcript features; ratios of an empty text are NULL. Characters are counted in Arrow batches, whole texts."""
    raw = F.coalesce(text, F.lit(""))
    counts = _character_counts(raw)
    size, unique, tokens, fillers, repeats = (counts[c] for c in _COUNTS)
    some = F.when(size > 0, size)
    return {
        "char_count": F.length(raw).cast("double"),
        "norm_char_count": size,
        "unique_char_count": unique,
        "unique_char_ratio": unique / some,
        "token_count": tokens,
        "filler_count": fillers,
        "filler_ratio": fillers / some,
        "repeat_count": repeats,
        "repeat_ratio": repeats / some,
        "chars_per_second": size / F.when(total_ms > 0, total_ms / 1000.0),
        "chars_per_sentence_overall": size / F.when(sentence_count != 0, sentence_count.cast("double")),
    }


def reference_deviation(text: Column, reference: Column) -> dict[str, Column]:
    """Seven length and edit-distance features of a text against one reference text."""
    seen, wanted = _kept_text(F.coalesce(text, F.lit(""))), norm_text(reference)
    n_seen, n_wanted = F.length(seen).cast("double"), F.length(wanted).cast("double")
    # Texts without a common character differ in every place, so the longer length is their exact distance.
    apart = F.length(F.call_function("translate", seen, wanted, F.lit(""))) == F.length(seen)
    distance = F.when(apart, F.greatest(n_seen, n_wanted)).otherwise(F.levenshtein(seen, wanted).cast("double"))
    per_wanted = F.greatest(n_wanted, F.lit(1.0))
    return {
        "reference_length": n_wanted,
        "observed_length": n_seen,
        "edit_distance": distance,
        "char_error_rate": distance / per_wanted,
        "length_ratio": n_seen / per_wanted,
        "deletion_proxy": F.greatest(n_wanted - n_seen, F.lit(0.0)) / per_wanted,
        "insertion_proxy": F.greatest(n_seen - n_wanted, F.lit(0.0)) / F.greatest(n_seen, F.lit(1.0)),
    }


def matched_characters(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts: longest block first, then left and right of it.

    Ties go to the earliest block in `a`, then in `b`. In a `b` of 200 or more characters those that make
    up over one percent start no block and only extend one. One vector step per character of `b`, over the
    characters of `a` that `b` has: of a run of others one is kept, which ends blocks as the run does.
    """
    av, bv = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a, b))
    chars, counts = np.unique(bv, return_counts=True)
    held = np.isin(av, chars)
    held[1:] |= held[:-1].copy()
    av = av[held]
    equal = {c: av == c for c in chars}
    popular = set(chars[counts > len(b) // 100 + 1]) if len(b) >= 200 else set()
    total, todo = 0, [(0, len(av), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        size, i, j = 0, a0, b0
        run = np.zeros(a1 - a0 + 1, dtype=np.int32)
        for col in range(b0, b1):
            # run[n + 1] is the length of the common run that ends at a[a0 + n] and b[col].
            if bv[col] in popular:
                run[:] = 0
                continue
            run[1:] = (run[:-1] + 1) * equal[bv[col]][a0:a1]
            end = int(run.argmax())
            here = int(run[end])
            if here > size or (here and here == size and a0 + end - here < i):
                size, i, j = here, a0 + end - here, col - here + 1
        while i > a0 and j > b0 and av[i - 1] == bv[j - 1]:
            size, i, j = size + 1, i - 1, j - 1
        while i + size < a1 and j + size < b1 and av[i + size] == bv[j + size]:
            size += 1
        if size:
            total += size
            todo += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return total


@F.pandas_udf(T.DoubleType())
def _ratio(seen: pd.Series, wanted: pd.Series) -> pd.Series:
    out = [2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in zip(seen, wanted)]
    return pd.Series(out, dtype="float64")


def sequence_ratio(text: Column, reference: Column) -> Column:
    """Longest-matching-block similarity of the normalised texts (Arrow UDF, whole texts)."""
    return _ratio(_kept_text(F.coalesce(text, F.lit(""))), norm_text(reference))
