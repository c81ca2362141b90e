"""Deterministic stand-ins for the model calls, used by the registered
queries and the tests (a real job passes its own batch function).  Each
one reads only the prompt it is given."""

from __future__ import annotations

import json

from ..functions.prompts import LOOK_AT_IMAGE


def prune_stub(prompts: list[str]) -> list[str]:
    """Proposes every caption tag of 9 or more characters for removal, plus
    one tag that is not in the caption, in the ``**Output:**`` form."""
    out = []
    for p in prompts:
        caption = p.rsplit("\n", 1)[-1] if "\n" in p else p
        tags = [t.strip() for t in caption.split(",") if len(t.strip()) >= 9]
        out.append("Sure.\n**Output:**\n```\n- " + ", ".join(tags + ["zz_not_there"]) + "\n```\nDone")
    return out


def artist_stub(prompts: list[str]) -> list[str]:
    """Echoes the prompt (as a generator does) and names the uploader, a
    guest artist and the uploader again."""
    out = []
    for p in prompts:
        up = p.split("### Uploader:\n", 1)[1].split("\n### Body:\n", 1)[0]
        body = p.split("\n### Body:\n", 1)[1].rsplit("\n<|output|>\n", 1)[0]
        out.append(p + f"{up}, guest_{len(body)}, {up}")
    return out


def chat_stub(model_id: str):
    """A chat model: in generate mode it answers ``- <short>_<stem>, solo``
    and a second line; in filter mode it drops the first two tags; it
    answers nothing for stems ending in 7 (a failed record)."""
    short = model_id.rsplit("/", 1)[-1]

    def call(requests: list[str]) -> list[str]:
        out = []
        for r in requests:
            user = json.loads(r)[1]["content"]
            text, url = user[0]["text"], user[1]["image_url"]["url"]
            stem = url.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if stem.endswith("7"):
                out.append("")
            elif LOOK_AT_IMAGE in text:
                out.append(f"- {short}_{stem}, solo\nThat is all.")
            else:
                tags = [t.strip() for t in text.split("\n\n")[-1].split(",") if t.strip()]
                out.append("- " + ", ".join(tags[2:]) + "\n(pruned)")
        return out
    return call


def no_calls(model):
    """A model that must not be asked: for stages whose answers are all stored."""
    def call(prompts):
        raise RuntimeError(f"{model} was asked {len(prompts)} requests that are answered already")
    return call
