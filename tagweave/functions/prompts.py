"""Prompt texts and the prompt builders (T13 caption prompts, T14 artist
prompts, T15 chat requests, the prune prompt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

# ---------------------------------------------------------------------------
# Prompt texts that must equal the original tool's word for
# word (template per caption type, in order: any length, a word count, a
# length word), the name option, the chat system text, the tag-generation
# line, the default artist instructions and the prune rules.
# ---------------------------------------------------------------------------
CAPTION_TYPE_MAP = {
    "Descriptive": [
        "Write a detailed description for this image.",
        "Write a detailed description for this image in {word_count} words or less.",
        "Write a {length} detailed description for this image.",
    ],
    "Descriptive (Casual)": [
        "Write a descriptive caption for this image in a casual tone.",
        "Write a descriptive caption for this image in a casual tone within {word_count} words.",
        "Write a {length} descriptive caption for this image in a casual tone.",
    ],
    "Straightforward": [
        "Write a straightforward caption for this image. Begin with the main subject and medium. Mention pivotal elements—people, objects, scenery—using confident, definite language. Focus on concrete details like color, shape, texture, and spatial relationships. Show how elements interact. Omit mood and speculative wording. If text is present, quote it exactly. Note any watermarks, signatures, or compression artifacts. Never mention what's absent, resolution, or unobservable details. Vary your sentence structure and keep the description concise, without starting with “This image is…” or similar phrasing.",
        "Write a straightforward caption for this image within {word_count} words. Begin with the main subject and medium. Mention pivotal elements—people, objects, scenery—using confident, definite language. Focus on concrete details like color, shape, texture, and spatial relationships. Show how elements interact. Omit mood and speculative wording. If text is present, quote it exactly. Note any watermarks, signatures, or compression artifacts. Never mention what's absent, resolution, or unobservable details. Vary your sentence structure and keep the description concise, without starting with “This image is…” or similar phrasing.",
        "Write a {length} straightforward caption for this image. Begin with the main subject and medium. Mention pivotal elements—people, objects, scenery—using confident, definite language. Focus on concrete details like color, shape, texture, and spatial relationships. Show how elements interact. Omit mood and speculative wording. If text is present, quote it exactly. Note any watermarks, signatures, or compression artifacts. Never mention what's absent, resolution, or unobservable details. Vary your sentence structure and keep the description concise, without starting with “This image is…” or similar phrasing.",
    ],
    "Stable Diffusion Prompt": [
        "Output a stable diffusion prompt that is indistinguishable from a real stable diffusion prompt.",
        "Output a stable diffusion prompt that is indistinguishable from a real stable diffusion prompt. {word_count} words or less.",
        "Output a {length} stable diffusion prompt that is indistinguishable from a real stable diffusion prompt.",
    ],
    "MidJourney": [
        "Write a MidJourney prompt for this image.",
        "Write a MidJourney prompt for this image within {word_count} words.",
        "Write a {length} MidJourney prompt for this image.",
    ],
    "Danbooru tag list": [
        "Generate only comma-separated Danbooru tags (lowercase_underscores). Strict order: `artist:`, `copyright:`, `character:`, `meta:`, then general tags. Include counts (1girl), appearance, clothing, accessories, pose, expression, actions, background. Use precise Danbooru syntax. No extra text.",
        "Generate only comma-separated Danbooru tags (lowercase_underscores). Strict order: `artist:`, `copyright:`, `character:`, `meta:`, then general tags. Include counts (1girl), appearance, clothing, accessories, pose, expression, actions, background. Use precise Danbooru syntax. No extra text. {word_count} words or less.",
        "Generate only comma-separated Danbooru tags (lowercase_underscores). Strict order: `artist:`, `copyright:`, `character:`, `meta:`, then general tags. Include counts (1girl), appearance, clothing, accessories, pose, expression, actions, background. Use precise Danbooru syntax. No extra text. {length} length.",
    ],
    "e621 tag list": [
        "Write a comma-separated list of e621 tags in alphabetical order for this image. Start with the artist, copyright, character, species, meta, and lore tags (if any), prefixed by 'artist:', 'copyright:', 'character:', 'species:', 'meta:', and 'lore:'. Then all the general tags.",
        "Write a comma-separated list of e621 tags in alphabetical order for this image. Start with the artist, copyright, character, species, meta, and lore tags (if any), prefixed by 'artist:', 'copyright:', 'character:', 'species:', 'meta:', and 'lore:'. Then all the general tags. Keep it under {word_count} words.",
        "Write a {length} comma-separated list of e621 tags in alphabetical order for this image. Start with the artist, copyright, character, species, meta, and lore tags (if any), prefixed by 'artist:', 'copyright:', 'character:', 'species:', 'meta:', and 'lore:'. Then all the general tags.",
    ],
    "Rule34 tag list": [
        "Write a comma-separated list of rule34 tags in alphabetical order for this image. Start with the artist, copyright, character, and meta tags (if any), prefixed by 'artist:', 'copyright:', 'character:', and 'meta:'. Then all the general tags.",
        "Write a comma-separated list of rule34 tags in alphabetical order for this image. Start with the artist, copyright, character, and meta tags (if any), prefixed by 'artist:', 'copyright:', 'character:', and 'meta:'. Then all the general tags. Keep it under {word_count} words.",
        "Write a {length} comma-separated list of rule34 tags in alphabetical order for this image. Start with the artist, copyright, character, and meta tags (if any), prefixed by 'artist:', 'copyright:', 'character:', and 'meta:'. Then all the general tags.",
    ],
    "Booru-like tag list": [
        "Write a list of Booru-like tags for this image.",
        "Write a list of Booru-like tags for this image within {word_count} words.",
        "Write a {length} list of Booru-like tags for this image.",
    ],
    "Art Critic": [
        "Analyze this image like an art critic would with information about its composition, style, symbolism, the use of color, light, any artistic movement it might belong to, etc.",
        "Analyze this image like an art critic would with information about its composition, style, symbolism, the use of color, light, any artistic movement it might belong to, etc. Keep it within {word_count} words.",
        "Analyze this image like an art critic would with information about its composition, style, symbolism, the use of color, light, any artistic movement it might belong to, etc. Keep it {length}.",
    ],
    "Product Listing": [
        "Write a caption for this image as though it were a product listing.",
        "Write a caption for this image as though it were a product listing. Keep it under {word_count} words.",
        "Write a {length} caption for this image as though it were a product listing.",
    ],
    "Social Media Post": [
        "Write a caption for this image as if it were being used for a social media post.",
        "Write a caption for this image as if it were being used for a social media post. Limit the caption to {word_count} words.",
        "Write a {length} caption for this image as if it were being used for a social media post.",
    ],
}

NAME_OPTION = "If there is a person/character in the image you must refer to them as {name}."

SYSTEM_PROMPT_BASE = """
Your task is to describe every aspect, object, and interaction within this image, such that a blind person could perfectly capture it within their imagination if read aloud. You need to do it multiple times, each one a different \"style\" of description. No intro/outro, just give several styles.
    \"Follow Character-LoRA tagging rules: \"
    \"\u2022 no prefixes/suffixes other than character-name, series, species, etc. \"
    \"\u2022 no style adjectives (e.g. 'high quality', 'masterpiece') \"
    \"\u2022 lowercase, single words where possible \"
    \"\u2022 use underscores_not_spaces \"
    \"\u2022 (((return ONLY a comma-separated list of tags, nothing else.)))""".strip()

LOOK_AT_IMAGE = "Look at the image and produce the most appropriate Character-LoRA tag string."

ARTIST_DEFAULT_INSTR = (
    "**Return ONE line ONLY** – a comma-separated list of artist names.\n"
    "Use underscores for internal spaces (e.g. `John_Doe`).\n"
    "If the uploader is an artist, include them; if none are mentioned, "
    "assume the uploader *is* the artist."
)

PRUNE_RULES = """
You are a tag-pruning assistant for Stable Diffusion *character* LoRA datasets. Follow every rule below and reply with a single comma-separated line of tags—no other text.

RULES
You are a tag-pruning assistant for Stable Diffusion *character* LoRA datasets.  
The user will send **one line of comma-separated tags**. Perform the following steps and reply with a **single comma-separated line**—no other text.

1. Activation token first  
   • Identify and keep the unique activation tag that names the character; place it at position #1.

2. Prune constant character traits  
   • Remove tags that are always true for this character (hair/eye colour, species, default outfit, gender, body type, etc.).

3. Keep only desired variable context  
   • Preserve tags that vary across images (pose, outfit, prop, scenery, lighting, camera angle, rating, etc.) **only if** you want that variation retained.  
   • Drop any tag the dataset should learn as part of the activation token.

4. Danbooru normalisation  
   • Lower-case ASCII.  
   • Replace spaces with underscores.  
   • Prefer singular nouns.  
   • Remove duplicates.  
   • After the activation token, sort remaining tags alphabetically.

5. Length cap  
   • Final list must contain **3 – 15 tags total** (including the activation token).  
   • If over the limit, remove the least-important context tags until within the range.

6. Disallowed content  
   • Do **not** output URLs, hashes, brackets, quotes, or any text that is not a valid Danbooru-style tag.

7. Strict output format of tags (TO REMOVE)  
   <tag2>, <tag3>, … <tagN>  
   • Single line, comma + single-space delimiter.  
   • No leading/trailing spaces, no trailing comma, no punctuation or commentary before/after the list.

(IMPORTANT final rules):
    • NO echoing the rules allowed.
    • NO echoing the input text.
    • *ONLY* provide the output text.
    • *ONLY* PROVIDE THE TAGS THAT YOU THINK SHOULD BE REMOVED
"""

# ---------------------------------------------------------------------------

# Modes of a chat request, and the error code of a record without tags.
GENERATE, FILTER = "generate", "filter"
FILTER_NEEDS_TAGS = "filter_needs_tags"


def caption_templates(spark) -> DataFrame:
    """The template table ``(caption_type, slot, template)`` (33 rows, a
    literal table whose size the planner knows)."""
    rows = [(t, i, s) for t, tpl in CAPTION_TYPE_MAP.items() for i, s in enumerate(tpl)]
    structs = [F.struct(F.lit(t).alias("caption_type"), F.lit(i).alias("slot"), F.lit(s).alias("template"))
               for t, i, s in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def length_slot(length: Column) -> Column:
    """Template slot: ``any`` -> 0, all digits -> 1, anything else -> 2."""
    return F.when(length == "any", 0).when(length.rlike(r"(?U)^\d+$"), 1).otherwise(2)


def fill_caption_prompt(template: Column, length: Column, extras: Column, name: Column) -> Column:
    """Template + extra options, then ``{length}``/``{word_count}``
    and finally ``{name}`` (so a name is inserted literally; an empty name
    becomes the text ``{NAME}``)."""
    base = F.when(F.size(extras) > 0, F.concat(template, F.lit(" "), F.array_join(extras, " "))).otherwise(template)
    filled = F.replace(F.replace(base, F.lit("{word_count}"), length), F.lit("{length}"), length)
    nm = F.when(F.coalesce(name, F.lit("")) == "", F.lit("{NAME}")).otherwise(name)
    return F.replace(filled, F.lit("{name}"), nm)


def caption_prompts(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """T13 over ``requests(key, caption_type, caption_length, extras, name)``:
    one prompt per request; the template table is joined by broadcast (33
    rows)."""
    r = requests.withColumn("slot", length_slot(F.col("caption_length")))
    j = r.join(F.broadcast(templates), ["caption_type", "slot"], "inner")
    return j.select("key", fill_caption_prompt(F.col("template"), F.col("caption_length"), F.col("extras"),
                                               F.col("name")).alias("prompt"))


def artist_prompt(instructions: Column, uploader: Column, body: Column) -> Column:
    """Substitute ``<UPLOADER>``, ``<POSTER>`` and ``<BODY>`` when the
    instructions hold any of them, else append the fixed header block."""
    has = instructions.contains("<UPLOADER>") | instructions.contains("<BODY>") | instructions.contains("<POSTER>")
    sub = F.replace(F.replace(F.replace(instructions, F.lit("<UPLOADER>"), uploader), F.lit("<POSTER>"), uploader),
                    F.lit("<BODY>"), body)
    block = F.concat(tx.rstrip_ws(instructions), F.lit("\n### Uploader:\n"), uploader, F.lit("\n### Body:\n"), body,
                     F.lit("\n<|output|>\n"))
    return F.when(has, sub).otherwise(block)


def prune_prompt(caption: Column) -> Column:
    """The prune request: the rules, a line break, the stripped caption."""
    return F.concat(F.lit(PRUNE_RULES + "\n"), tx.strip_ws(caption))


def chat_user_text(mode: str, extra, tag_text: Column) -> Column:
    """T15 user text: the stripped extra prompt and a blank line when there
    is one, then the normalised tags (filter mode) or the fixed line.
    ``extra`` is a string or a column (one extra prompt per model)."""
    ex = tx.strip_ws(F.lit(extra) if isinstance(extra, str) else extra)
    lead = F.when(ex != "", F.concat(ex, F.lit("\n\n"))).otherwise(F.lit(""))
    body = tx.normalize_delimiters(tag_text) if mode == FILTER else F.lit(LOOK_AT_IMAGE)
    return F.concat(lead, body)


_PART = "struct<type:string,text:string,image_url:struct<url:string>>"


def chat_messages(user_text: Column, image_ref: Column) -> Column:
    """T15 message list: system text, then a user turn with the text and
    the image reference, as JSON."""
    sys_part = F.struct(F.lit("text").alias("type"), F.lit(SYSTEM_PROMPT_BASE).alias("text"),
                        F.lit(None).cast("struct<url:string>").alias("image_url"))
    txt_part = F.struct(F.lit("text").alias("type"), user_text.alias("text"),
                        F.lit(None).cast("struct<url:string>").alias("image_url"))
    img_part = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                        F.struct(image_ref.alias("url")).alias("image_url"))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.array(sys_part).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.array(txt_part, img_part).alias("content")))
    return F.to_json(msgs)


def chat_requests(items: DataFrame, mode: str, extra, image: str = "image", tags: str = "tag_text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """T15 over ``items(image, tag_text)`` (``tag_text`` NULL when the image
    has no tag file): ``(image, user_text, request, error)``; in filter mode
    an image without tags gets the error and no request."""
    ut = chat_user_text(mode, extra, F.col(tags))
    bad = F.lit(mode == FILTER) & F.col(tags).isNull()
    return items.select(
        *keep, image,
        F.when(~bad, ut).alias("user_text"),
        F.when(~bad, chat_messages(ut, F.col(image))).alias("request"),
        F.when(bad, F.lit(FILTER_NEEDS_TAGS)).alias("error"))
