"""Text parsing rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats other tools of the lab read and write.
FRAMEWORKS = (
    ("pytorch", ("torch",)),
    ("sklearn", ("sklearn", "scikit")),
    ("tensorflow", ("tensorflow", "keras")),
)
NO_FRAMEWORK = "python"
BLOB_START = '_MODEL_B64 = """'
BLOB_END = '"""'
SCRIPT = r"(?is)<script.*?</script>"
CHECKPOINT_FORMAT = "models/%s/checkpoints/epoch_%04d.pt"
LATEST_CHECKPOINT = "models/%s/checkpoints/latest.pt"
CHECKPOINT_EPOCH = r"/epoch_(\d+)\.pt$"
ERROR_LENGTH = 4096

BLOB = r'(?s)_MODEL_B64 = """(.*?)"""'


def base64_text(content: Column) -> Column:
    """Base64 in one line, whether or not the session breaks it into lines."""
    return F.translate(F.base64(content), "\r\n", "")


def framework_of(source: Column, rules=FRAMEWORKS, otherwise: str = NO_FRAMEWORK) -> Column:
    """The first framework one of whose words occurs in the text."""
    out = F.lit(otherwise)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for word in words:
            hit = hit | source.contains(word)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def embedded_blob(source: Column) -> Column:
    """Bytes of the embedded model; null without one, an error if it is not base64."""
    found = F.regexp_extract(source, BLOB, 1)
    return F.when(source.rlike(BLOB), F.unbase64(F.trim(found)))


def replace_blob(source: Column, content: Column) -> Column:
    """The text with its embedded model exchanged; unchanged without one.

    Base64 has neither a dollar sign nor a backslash, so it is a literal replacement.
    """
    return F.regexp_replace(source, F.lit(BLOB), F.concat(F.lit(BLOB_START), base64_text(content), F.lit(BLOB_END)))


def last_data_line(block: Column) -> Column:
    """Payload of the last ``data:`` line of an event block; null if there is none."""
    lines = F.filter(F.split(F.trim(block), "\n"), lambda line: line.startswith("data:"))
    return F.nullif(F.trim(F.substr(F.try_element_at(lines, F.lit(-1)), F.lit(6))), F.lit(""))


def event_payload(block: Column) -> Column:
    """The payload as JSON; text that is not JSON comes as ``{"raw": text}``."""
    data = last_data_line(block)
    raw = F.to_json(F.struct(data.alias("raw")))
    return F.when(data.isNull(), None).when(F.try_parse_json(data).isNotNull(), data).otherwise(raw)


def strip_script(markup: Column) -> Column:
    return F.regexp_replace(markup, SCRIPT, "")


def checkpoint_key(model: Column, epoch: Column) -> Column:
    text = model.cast("string")
    return F.when(epoch.isNotNull(), F.format_string(CHECKPOINT_FORMAT, text, epoch)).otherwise(
        F.format_string(LATEST_CHECKPOINT, text)
    )


def checkpoint_epoch(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, CHECKPOINT_EPOCH, 1), F.lit("")).try_cast("int")
