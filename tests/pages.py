"""What a reader sees of a page, by the standard library's parser: the plain-Python counterpart of ``functions.html``."""

from html.parser import HTMLParser

from marginalia.functions.html import ENDS_ITSELF, ENDS_P, NO_END
from marginalia.functions.text import BLOCK_TAGS, DROPPED_TAGS


def visible_text(html: str | None) -> str:
    """The text of what is neither dropped nor hidden, entities decoded, with a line break at each block tag's start and end."""
    blocks, dropped = set(BLOCK_TAGS) - {"br"}, set(DROPPED_TAGS)
    out: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether what they hold is out

    def close(at: int) -> None:
        while len(stack) > at:
            tag, gone = stack.pop()
            if tag in blocks and not gone:
                out.append("\n")

    def last(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stops:
                return None
        return None

    class Walk(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ENDS_P and tag != "br" and (at := last(("p",), ("td", "th", "button", "object"))) is not None:
                close(at)
            if tag in ENDS_ITSELF and (at := last((tag,), ENDS_ITSELF[tag])) is not None:
                close(at)
            a = {k: (v or "") for k, v in attrs}
            style = a.get("style", "").lower().replace(" ", "")
            gone = tag in dropped or tag.startswith("ix:hidden") or "hidden" in a or a.get("aria-hidden") == "true"
            gone = gone or "display:none" in style or "visibility:hidden" in style or bool(stack and stack[-1][1])
            if tag == "br" and not gone:
                out.append("\n\n")
            elif tag in blocks and not gone:
                out.append("\n")
            if tag not in NO_END:
                stack.append((tag, gone))

        def handle_endtag(self, tag):
            at = last((tag,))
            if at is not None:
                close(at)

        def handle_data(self, data):
            if not (stack and stack[-1][1]):
                out.append(data)

    walk = Walk(convert_charrefs=True)
    source = html or ""
    walk.feed(source[: source.rfind("<")] if source.rfind("<") > source.rfind(">") and source[source.rfind("<") + 1 :][:1] in _TAG_STARTS else source)
    walk.close()
    close(0)
    return "".join(out)


_TAG_STARTS = tuple("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!")  # an element that the source breaks off in is none
