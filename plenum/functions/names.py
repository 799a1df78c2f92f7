"""Names of models, prompt versions and their aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import strip

# Strings that stored records carry, and accepted model spellings.  They are data: the
# operators take them as defaults from here.
PIPELINE = "acccollab_original"
PROMPT_VERSION = "acccollab_iclr2025_appendix_c_mmlu_v2"
ROLE_VERSION = "acccollab_role_prefix_v1"
MODEL_ALIASES = {
    "llama3": "llama3",
    "llama38b": "llama3",
    "llama38binstruct": "llama3",
    "mistral": "mistral",
    "mistral7b": "mistral",
    "mistral7binstruct": "mistral",
    "gemma2": "gemma2",
    "gemma22b": "gemma2",
    "gemma22binstruct": "gemma2",
}


def prompt_version(role: Column, role_version: str = ROLE_VERSION, base: str = PROMPT_VERSION) -> Column:
    """Base version, with the role's version behind it for a specialized role."""
    name = strip(F.coalesce(role, F.lit("")))
    special = F.concat(F.lit(f"{base}+{role_version.strip()}:"), name)
    return F.when(name.isin("", "original"), F.lit(base)).otherwise(special)


def model_alias(name: Column, aliases: dict[str, str] = MODEL_ALIASES) -> Column:
    """Short model key, NULL for an unknown spelling."""
    plain = F.translate(F.lower(strip(name)), "-_", "")
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.try_element_at(table, plain)
