"""The command table, authentication, validation and replication of a command log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commands by handler and required password; those in REPLICATED go to binlogs and replicas.
HANDLERS = {
    ("config", "info"): "PING CHECK INFO STATS",
    ("config", "admin"): "SHUTDOWN LOADCONFIG RESTORE STORE GET SET LOG ROTATE",
    ("session", "user"): "READ WRITE DESTROY GC",
    ("fpc", "user"): "LOAD TEST SAVE REMOVE GETFILLINGPERCENTAGE GETMETADATAS TOUCH",
    ("fpc_tag", "user"): "CLEAN GETIDS GETTAGS GETIDSMATCHINGTAGS GETIDSNOTMATCHINGTAGS GETIDSMATCHINGANYTAGS",
}
REPLICATED = "WRITE DESTROY GC SAVE REMOVE CLEAN TOUCH"


def command_dim(spark: SparkSession) -> DataFrame:
    """op, handler, auth and replicate of the 29 commands."""
    rows = [(op, handler, auth, op in REPLICATED.split()) for (handler, auth), ops in HANDLERS.items() for op in ops.split()]
    return spark.createDataFrame(rows, "op string, handler string, auth string, replicate boolean")


def routed(log: DataFrame) -> DataFrame:
    # the table of commands is fixed
    return log.join(F.broadcast(command_dim(log.sparkSession)), "op")


def authenticated(auth: Column, provided: Column, info_auth: str = "none", user_set: bool = True, admin_set: bool = True) -> Column:
    """Whether the provided password (none, user, admin, bulk; taken as right) is enough for a command that requires auth."""
    required = F.when(auth == "info", F.lit(info_auth)).otherwise(auth)
    required = F.when((required == "user") & F.lit(not user_set) | (required == "admin") & F.lit(not admin_set), F.lit("none")).otherwise(required)
    return (required == "none") | (provided == "admin") | (required == "user") & provided.isin("user", "bulk")


def status(id_: Column, ua: Column, lifetime: Column) -> Column:
    """ok, or what is wrong with a command's arguments."""
    n = F.octet_length(id_)
    return F.when(n.isNull() | (n < 1) | (n > 65_535), "bad name").when(ua.isNull() | (ua < 0) | (ua > 3), "bad user agent").when((lifetime < -1) | (lifetime > 4_294_967_295), "bad lifetime").otherwise("ok")
