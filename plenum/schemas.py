"""Explicit schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SAMPLE = _struct(
    dataset=_S,
    source_split=_S,
    source_index=_L,
    subject=_S,
    category=_S,
    question=_S,
    passage=_S,
    answer=_S,
    raw_answer=_S,
    choices=T.ArrayType(_S),
    choice_labels=T.ArrayType(_S),
    source_choice_labels=T.ArrayType(_S),
    task_type=_S,
    sample_id=_S,
    sample_index=_L,
    bbh_raw_target=_S,
    bbh_source_index=_L,
    bbh_source_warning=_S,
)

GENERATION = _struct(
    finish_reason=_S, generated_tokens=_I, max_tokens=_I, length_truncated=_B
)

COMPLETION = _struct(
    raw_response=_S,
    response=_S,
    truncated=_B,
    truncation_reason=_S,
    generation=GENERATION,
    answer=_S,
    answer_source=_S,
    parse_confidence=_D,
    parsed=_B,
    correct=_B,
    empty_response_retries=_I,
    empty_response_exhausted=_B,
)

TURN = _struct(prompt=_S, completion=COMPLETION)
ROUND = _struct(round=_I, actor=TURN, critic=TURN)

RECORD = _struct(
    trial=_I,
    sample_id=_S,
    sample=SAMPLE,
    pipeline=_S,
    prompt_version=_S,
    decision_rule=_S,
    uses_majority_vote=_B,
    uses_judge_fallback=_B,
    rounds=T.ArrayType(ROUND),
)

REWARDS = _struct(natural=_D, guided_positive=_D, guided_negative=_D)
DELTAS = _struct(guided_positive_minus_natural=_D, natural_minus_guided_negative=_D)

PAIR = _struct(
    prompt=_S,
    chosen=_S,
    rejected=_S,
    metadata=_struct(
        schema_version=_I,
        pipeline=_S,
        agent=_S,
        iteration=_I,
        sample_id=_S,
        sample_index=_L,
        round=_I,
        case_type=_S,
        chosen_candidate=_S,
        rejected_candidate=_S,
        rewards=REWARDS,
        deltas=DELTAS,
        epsilon=_D,
        reward_rollouts=_I,
        pair_rule=_S,
        dpo_prompt_source=_S,
        prompt_version=_S,
    ),
)

DECISION = _struct(
    schema_version=_I,
    pipeline=_S,
    dataset=_S,
    variant=_S,
    sample_id=_S,
    sample_index=_L,
    task_type=_S,
    gold_answer=_S,
    rounds=T.ArrayType(
        _struct(
            round=_I,
            role_votes=T.MapType(_S, _S),
            decision=_struct(
                answer=_S,
                source=_S,
                selected_role=_S,
                majority_reached=_B,
                vote_count=_L,
            ),
            correct=_B,
        )
    ),
)

LENGTH_GROUP = _struct(
    outputs=_L,
    length_finished=_L,
    generated_tokens_total=_L,
    generated_tokens_observed=_L,
    token_histogram=T.MapType(_S, _L),
)
LENGTH_STATS = _struct(schema_version=_I, by_max_tokens=T.MapType(_S, LENGTH_GROUP))

_SIMPLE = {"string": _S, "bigint": _L, "int": _I, "double": _D, "boolean": _B}


def simple(columns: str) -> T.StructType:
    """Flat schema from "name type, name type" (no session needed)."""
    pairs = [part.split() for part in columns.split(",")]
    return _struct(**{name: _SIMPLE[kind] for name, kind in pairs})
