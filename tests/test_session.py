"""Session helpers on a stand-in for the JVM."""

from unittest.mock import MagicMock

from tallyweir.session import release_finished


def test_release_gives_native_memory_back():
    spark, invoke = MagicMock(), MagicMock()
    invoke.getName.return_value = "invoke"
    spark.sparkContext._jvm.java.lang.Class.forName.return_value.getMethods.return_value = [invoke]
    spark.sparkContext._gateway.new_array.side_effect = lambda kind, n: [None] * n
    release_finished(spark)
    assert spark.sparkContext._jvm.System.gc.called and invoke.invoke.call_args[0][1][1] == "systemTrimNativeHeap"
