"""Time queries with a no-op sink: python -m tests.timing sf name ..."""
import sys, time
import __spark_entry__ as e
from postmill.session import build_session

sf, names = sys.argv[1], sys.argv[2:]
spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
spark.sparkContext.setLogLevel("ERROR")
for n in e.queries():
    if names and not any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names):
        continue
    ts = []
    for _ in range(2):
        t = time.time()
        e.queries()[n](spark, f"/root/testdata/sf{sf}").write.format("noop").mode("overwrite").save()
        ts.append(time.time() - t)
    print(n, " ".join(f"{x:.2f}" for x in ts), flush=True)
