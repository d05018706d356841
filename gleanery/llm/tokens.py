"""Documents sized in tokens of a public byte-level BPE, whose vocabulary file is a parameter and stays outside the repository."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoding(path: str):
    """Loaded once per Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, keys: list[str], vocabulary: str | None = None) -> DataFrame:
    """(keys, tokens): every text counted in full; a null or empty text has none."""
    path = vocabulary or default_vocabulary()
    ddl = {f.name: f.dataType.simpleString() for f in docs.schema}

    def count(batches):
        import pyarrow as pa

        for b in batches:
            counts = [len(encoding(path).encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(counts, pa.int64())], names=[*keys, "tokens"])

    return docs.select(*keys, F.col("text")).mapInArrow(count, ", ".join(f"`{k}` {ddl[k]}" for k in keys) + ", tokens bigint")
