"""WAV files as block tables and back (16-bit PCM, any number of channels)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.operators.signals import pcm16_value
from songloom.session import materialized

BLOCK_SAMPLES = 65536
# Samples of all channels together in one file: half a GiB, so a file fits into a row with room to spare.
FILE_SAMPLES = 2**28
BLOCK_SCHEMA = "signal_id string, ch int, block_no bigint, start_idx bigint, sr int, samples array<smallint>"


def audio_scan(spark: SparkSession, path: str, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Read a folder of WAV files into blocks; ``signal_id`` is the file name.

    The ``binaryFile`` source splits by file; each file is decoded run by run
    and leaves the worker as bounded blocks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        import numpy as np

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as wav:
                    if wav.getsampwidth() != 2:
                        raise ValueError(f"only 16-bit PCM can be read: {name}")
                    channels, rate = wav.getnchannels(), wav.getframerate()
                    stem = name.rsplit("/", 1)[-1].removesuffix(".wav")
                    start = 0
                    while run := wav.readframes(block):
                        data = np.frombuffer(run, dtype="<i2").reshape(-1, channels)
                        yield pd.DataFrame({
                            "signal_id": stem, "ch": list(range(channels)), "block_no": start // block,
                            "start_idx": start, "sr": rate, "samples": [data[:, c] for c in range(channels)],
                        })
                        start += len(data)

    return files.mapInPandas(decode, BLOCK_SCHEMA)


def float_blocks_to_pcm(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("samples", F.transform("samples", pcm16_value))


def encode_wav(blocks: DataFrame, max_samples: int = FILE_SAMPLES) -> DataFrame:
    """WAV files of signals: ``signal_id, part, sr, n_samples, n_bytes, wav BINARY``.

    A WAV is one byte string, so its samples meet in one row. The format ends
    at 4 GiB and a row at 2, so a signal is cut into parts of about
    ``max_samples`` samples, all channels counted, numbered from 0; nothing is
    left out and no group grows with the signal.
    """
    # whole blocks only: a block belongs to the part its first sample falls in
    channels = materialized(blocks.groupBy("signal_id").agg(F.countDistinct("ch").alias("_channels")), "channels")
    part = F.floor(F.col("start_idx") * F.col("_channels") / max_samples)
    out = "signal_id string, part bigint, sr int, n_samples bigint, n_bytes bigint, wav binary"

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import wave

        import numpy as np

        pdf = pdf.sort_values(["start_idx", "ch"])
        channels = pdf["ch"].nunique()
        sr = int(pdf["sr"].iat[0])
        buf, total = io.BytesIO(), 0
        with wave.open(buf, "wb") as wav:
            wav.setnchannels(channels)
            wav.setsampwidth(2)
            wav.setframerate(sr)
            for _, parts in pdf.groupby("start_idx", sort=True):
                data = np.stack([np.asarray(p, dtype="<i2") for p in parts["samples"]], axis=1)
                wav.writeframes(data.tobytes())
                total += len(data)
        raw = buf.getvalue()
        return pd.DataFrame([(key[0], key[1], sr, total, len(raw), raw)], columns=["signal_id", "part", "sr", "n_samples", "n_bytes", "wav"])

    return blocks.join(channels, "signal_id").select(
        F.col("signal_id").cast("string").alias("signal_id"), part.alias("part"), "ch", "start_idx", "sr", "samples"
    ).groupBy("signal_id", "part").applyInPandas(write, out)


def audio_export(blocks: DataFrame) -> DataFrame:
    """Sizes of the encoded files, without the bytes."""
    return encode_wav(blocks).drop("wav")


def write_wav_files(encoded: DataFrame, folder: str) -> None:
    """Write each encoded signal as ``<folder>/<signal_id>.wav`` from the tasks.

    Further parts of a signal go to ``<folder>/part=<n>/<signal_id>.wav``, a
    folder of its own for each part, so no part takes the name of a signal.
    ``folder`` is a path or URI every executor can reach. A file is written
    under a name of its own and then moved, so a repeated task leaves the same
    result.
    """
    def save(rows) -> None:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for row in rows:
            place = f"{root}/part={row.part}" if row.part else root
            store.create_dir(place, recursive=True)
            started = f"{place}/.{row.signal_id}-{uuid.uuid4().hex}"
            with store.open_output_stream(started) as out:
                out.write(row.wav)
            store.move(started, f"{place}/{row.signal_id}.wav")

    encoded.select("signal_id", "part", "wav").foreachPartition(save)
