import random

from tessella.operators.ordered import dialogue_lines
from tessella.streaming.dialogue import stream_dialogue

COMMANDS = "path string, seq int, opcode int, args array<int>"


def test_a_stream_gives_the_lines_of_the_whole(spark, tmp_path):
    r = random.Random(1)
    rows = [(p, i, r.choice([0x1D, 0x22, 0x4B, 0x4B, 0x10]), [r.randrange(9) for _ in range(r.randrange(3))]) for p in "abc" for i in range(60)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = None
    for k in range(4):
        part = [x for x in rows if x[1] // 15 == k]
        r.shuffle(part)
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream_dialogue(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted(map(tuple, dialogue_lines(spark.createDataFrame(rows, COMMANDS)).collect()), key=str)
