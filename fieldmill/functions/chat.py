"""Chat messages, chat text, token ids, loss masks: all row-local array columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.draws import draw
from fieldmill.functions.text import BLANKS

# Label of unsupervised positions, special ids and prompt texts.
IGNORE_INDEX = -100
PAD_ID = 0
EOS_ID = 2
IMAGE_ID = 900
WORD_ID = 1000
IMAGE_TOKENS = 4
RECEIPT_INSTRUCTION = (
    "You are a receipt parser. Extract the requested fields from the receipt image "
    "and return STRICT, minified JSON with exactly these top-level keys: "
    "vendor, date (YYYY-MM-DD), items (list of items with name, count, price), "
    "subtotal, tax, total. "
    "Output ONLY the JSON object, no explanations, no markdown fences."
)

PART_TYPE = "struct<type:string,text:string>"
MESSAGE_TYPE = f"struct<role:string,content:array<{PART_TYPE}>>"


@dataclass(frozen=True)
class ChatTemplate:
    """How roles and parts become text.  The prompt is a strict prefix of the full text."""

    image: str = "<img>"
    generation: str = "ASSISTANT:"
    roles: dict[str, str] = field(
        default_factory=lambda: {"system": "SYSTEM:", "user": "", "assistant": "ASSISTANT:"}
    )


def _column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def text_part(text: str | Column) -> Column:
    return F.struct(F.lit("text").alias("type"), _column(text).alias("text"))


def image_part() -> Column:
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))


def message(role: str | Column, *parts: Column) -> Column:
    return F.struct(_column(role).alias("role"), F.array(*parts).alias("content"))


def build_messages(
    instruction: str | Column, target: Column | None = None, image: bool = True
) -> Column:
    """User message (image and instruction) and, where there is a target, the answer."""
    parts = [image_part()] if image else []
    user = message("user", *parts, text_part(instruction)).cast(MESSAGE_TYPE)
    if target is None:
        return F.array(user)
    answer = message("assistant", text_part(target)).cast(MESSAGE_TYPE)
    return F.when(target.isNotNull(), F.array(user, answer)).otherwise(F.array(user))


def render_chat(
    messages: Column, template: ChatTemplate | None = None, add_generation_prompt: bool = False
) -> Column:
    """Messages -> chat text; ``add_generation_prompt`` opens the assistant's turn."""
    template = template or ChatTemplate()

    def part_text(part: Column) -> Column:
        return F.when(part["type"] == "image", F.lit(template.image)).otherwise(part["text"])

    def turn(m: Column) -> Column:
        prefix = F.lit("")
        for role, opening in template.roles.items():
            prefix = F.when(m["role"] == role, F.lit(opening)).otherwise(prefix)
        body = F.array_join(F.transform(m["content"], part_text), " ")
        return F.concat_ws(" ", F.when(prefix != "", prefix), body)

    text = F.array_join(F.transform(messages, turn), " ")
    return F.concat_ws(" ", text, F.lit(template.generation)) if add_generation_prompt else text


def tokenize(
    text: Column,
    image_tokens: int | Column = IMAGE_TOKENS,
    vocabulary: int = 1000,
    image: str = "<img>",
) -> Column:
    """Whitespace tokens -> ``array<struct<id:int,kind:int>>``.

    An image placeholder becomes ``image_tokens`` tokens of kind 1; a word's id
    is an md5 draw from the vocabulary, so equal words have equal ids everywhere.
    """
    blank = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]+"
    words = F.filter(F.split(text, blank), lambda w: w != "")
    count = F.lit(image_tokens) if isinstance(image_tokens, int) else image_tokens

    def token(identity: Column, kind: int) -> Column:
        return F.struct(identity.cast("int").alias("id"), F.lit(kind).alias("kind"))

    picture = F.transform(
        F.sequence(F.lit(0), count.cast("int") - 1), lambda j: token(F.lit(IMAGE_ID) + j, 1)
    )
    return F.flatten(
        F.transform(
            words,
            lambda w: F.when(w == image, picture).otherwise(
                F.array(token(F.lit(WORD_ID) + draw(F.md5(w), 1, 8, vocabulary), 0))
            ),
        )
    )


def tokenize_with(
    text: Column,
    make_encoder: Callable[[], Callable[[str], list[int]]],
    image_tokens: int | Column = IMAGE_TOKENS,
    image: str = "<img>",
) -> Column:
    """Token ids of a tokenizer the caller brings, same result type as ``tokenize``.

    The encoder is made once per task and sees Arrow batches of text pieces; image
    placeholders between the pieces are expanded natively.
    """

    @F.pandas_udf("array<array<int>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for pieces in batches:
            yield pieces.map(
                lambda row: None if row is None else [list(encoder(p)) if p else [] for p in row]
            )

    pieces = encode(F.split(text, re.escape(image)))
    count = F.lit(image_tokens) if isinstance(image_tokens, int) else image_tokens
    picture = F.transform(
        F.sequence(F.lit(0), count.cast("int") - 1),
        lambda j: F.struct((F.lit(IMAGE_ID) + j).cast("int").alias("id"), F.lit(1).alias("kind")),
    )
    none = F.array().cast("array<struct<id:int,kind:int>>")
    return F.flatten(
        F.transform(
            pieces,
            lambda ids, i: F.concat(
                F.when(i > 0, picture).otherwise(none),
                F.transform(
                    ids, lambda x: F.struct(x.alias("id"), F.lit(0).alias("kind"))
                ),
            ),
        )
    )


def truncate_tokens(tokens: Column, max_len: int) -> Column:
    return F.slice(tokens, F.lit(1), F.lit(max_len))


def label_mask(ids: Column, prompt_len: Column) -> Column:
    """Labels equal the ids; the prompt's positions are ignored."""
    masked = F.least(prompt_len, F.size(ids))
    return F.concat(
        F.array_repeat(F.lit(IGNORE_INDEX), masked), F.slice(ids, masked + 1, F.size(ids))
    )


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def pad_id(pad: Column | None, eos: Column) -> Column:
    """The tokenizer's pad id, or its end-of-sequence id where it has none."""
    return eos if pad is None else F.coalesce(pad, eos)
