"""Per-trajectory state machines: a step function for streams and experts, and the same in window functions for batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Episode:
    """State of one trajectory."""

    steps: int = 0
    done: bool = False
    total: float = 0.0
    last: float = 0.0
    invalid: int = 0
    seen: list = field(default_factory=list)


@dataclass(frozen=True)
class Protocol:
    """What actions are worth, and when a trajectory ends."""

    rewards: dict[str, float]
    final: str
    max_steps: int = 6
    invalid_penalty: float = -0.5
    repeat_penalty: float = -0.1
    timeout_penalty: float = -1.0

    def step(self, s: Episode, action: str, value: float) -> float:
        """The reward of one action; nothing changes once a trajectory is done."""
        if s.done:
            return 0.0
        s.steps += 1
        if action not in self.rewards:
            reward = self.invalid_penalty
            s.invalid += 1
        else:
            reward = self.rewards[action] * value + (self.repeat_penalty if action in s.seen else 0.0)
            if action not in s.seen:
                s.seen.append(action)
        if action == self.final:
            s.done = True
        elif s.steps >= self.max_steps:
            s.done = True
            reward += self.timeout_penalty
        s.total += reward
        s.last = reward
        return reward

    def next_action(self, s: Episode) -> str:
        """The expert's action: each rewarded action once, then the final one."""
        rest = [a for a in self.rewards if a != self.final and a not in s.seen]
        return rest[0] if rest and s.steps < self.max_steps - 1 else self.final


#: Protocols by name, for streams and batch alike.
ENVIRONMENTS: dict[str, Protocol] = {}


def environment(name: str, protocol: Protocol | None = None) -> Protocol:
    """Registers a protocol under a name, or gives the one registered."""
    if protocol is not None:
        ENVIRONMENTS[name] = protocol
    return ENVIRONMENTS[name]


def trace(events: DataFrame, protocol: Protocol, key: str, order: str, action: str, value: str) -> DataFrame:
    """Each step with its reward and the total so far, in window functions.

    A trajectory ends with its first final action or its last step allowed, so
    only its first ``max_steps`` events are kept before anything else is done,
    and no trajectory is long.  A null value is worth 0.
    """
    d = events.select(key, F.col(order).alias("at"), F.col(action).alias("action"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    d = d.withColumn("step", F.row_number().over(W.partitionBy(key).orderBy("at"))).where(F.col("step") <= protocol.max_steps)
    ends = F.min(F.when(F.col("action") == protocol.final, F.col("step"))).over(W.partitionBy(key))
    d = d.withColumn("_end", ends).where(F.col("_end").isNull() | (F.col("step") <= F.col("_end")))
    worth = F.try_element_at(F.create_map(*(F.lit(x) for pair in protocol.rewards.items() for x in pair)), F.col("action"))
    again = F.row_number().over(W.partitionBy(key, "action").orderBy("step")) > 1
    is_final = F.coalesce(F.col("action") == protocol.final, F.lit(False))
    d = d.withColumns({"_worth": worth, "_again": again})
    reward = F.when(F.col("_worth").isNull(), protocol.invalid_penalty).otherwise(F.col("_worth") * F.col("_v") + F.when(F.col("_again"), protocol.repeat_penalty).otherwise(0.0))
    late = F.when((F.col("step") >= protocol.max_steps) & ~is_final, protocol.timeout_penalty).otherwise(0.0)
    d = d.withColumn("reward", reward + late).withColumn("total", F.sum("reward").over(W.partitionBy(key).orderBy("step")))
    done = is_final | (F.col("step") >= protocol.max_steps)
    return d.select(key, F.col("step").cast("long").alias("step"), F.col("at").cast("long").alias("at"), "action", "reward", "total", done.alias("done"), F.col("_worth").isNull().alias("invalid"))


def replay(events: DataFrame, protocol: Protocol, key: str, order: str, action: str, value: str) -> DataFrame:
    """Final state of each trajectory."""
    d = trace(events, protocol, key, order, action, value)
    return d.groupBy(key).agg(F.max("step").alias("steps"), F.max("done").alias("done"), F.sum("reward").alias("total_reward"), F.count_if("invalid").alias("n_invalid"))


def expert(keys: DataFrame, protocol: Protocol, key: str) -> DataFrame:
    """Alternating messages of the expert's trajectory for each key.  It depends on the protocol alone, so it is played once."""
    s, said = Episode(), []
    while not s.done:
        a = protocol.next_action(s)
        said.append((2 * s.steps, "assistant", f'<think>step {s.steps + 1}</think>{{"action":"{a}"}}'))
        r = protocol.step(s, a, 1.0)
        said.append((2 * s.steps - 1, "user", f"reward {r:.2f}"))
    messages = F.array(*(F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(content).alias("content")) for turn, role, content in said))
    return keys.select(key, F.inline(messages))


def rounds(starts: DataFrame, advance: Callable[[DataFrame], DataFrame], most: int) -> tuple[DataFrame, int]:
    """Advances all unfinished rows together until none is left, at most ``most`` times.

    ``advance`` gets rows with a boolean ``done``, of which it changes the
    unfinished ones; each round is cut off by a checkpoint.
    """
    d, n = starts, 0
    while n < most and not d.where("NOT done").isEmpty():
        d = advance(d).checkpoint()
        n += 1
    return d, n


def summary(final: DataFrame) -> DataFrame:
    return final.agg(F.count("*").alias("n"), F.avg(F.col("done").cast("double")).alias("completion"), F.avg((F.col("n_invalid") > 0).cast("double")).alias("with_invalid"), F.avg("steps").alias("mean_turns"), F.avg("total_reward").alias("mean_reward"))


def state_row(s: Episode) -> tuple:
    return tuple(asdict(s)[k] for k in ("steps", "done", "total", "last", "invalid")) + (",".join(s.seen),)


def state_of(row: tuple | None) -> Episode:
    if row is None:
        return Episode()
    steps, done, total, last, invalid, seen = row
    return Episode(int(steps), bool(done), float(total), float(last), int(invalid), [x for x in seen.split(",") if x])
