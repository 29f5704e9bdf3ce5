"""Options and performance counters as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagfold.functions import scalars

#: Options with a shipped value that is no path.
OPTIONS = """
max_memory 0b
max_session_memory 0b
max_fpc_memory 0b
listener_addresses localhost
listener_port 8120
session_replicator_port 8120
fpc_replicator_port 8120
listener_persistent true
session_replicator_persistent true
fpc_replicator_persistent true
info_password_type none
log_level normal
log_rotation_threshold 16M
num_connection_threads 2
session_lock_wait_time 8000
session_first_write_lifetimes 30s 1m 2m 10m
session_first_write_nums 100 50 20 10
session_default_lifetimes 1h 2h 1d 2w
session_read_extra_lifetimes 30s 1m 2m 2w
fpc_default_lifetimes 1d 2d 20d 60d
fpc_read_extra_lifetimes 1d 2d 20d 60d
fpc_max_lifetimes 10d 30d 60d 60d
session_eviction_mode expiration-lru
fpc_eviction_mode lru
session_optimization_interval 20s
fpc_optimization_interval 20s
session_recompression_threshold 256b
fpc_recompression_threshold 256b
response_compression_threshold 2k
session_tables_per_store 4
fpc_tables_per_store 8
tags_tables_per_store 2
health_check_interval 10m
free_disk_space_warning_threshold 64M
thread_activity_time_warning_threshold 5000
global_response_compressor zlib
session_response_compressor snappy
fpc_response_compressor snappy
command_integrity_check true
response_integrity_check false
binlog_integrity_check true
session_binlog_rotation_threshold 256M
fpc_binlog_rotation_threshold 256M
session_binlog_sync none
fpc_binlog_sync none
session_db_sync data-only
fpc_db_sync none
session_db_include user
fpc_db_include bot
session_auto_save_interval 30m
fpc_auto_save_interval 4h
table_hash_method xxhash
password_hash_method murmurhash2
include <path>
perf_dealloc_chunk_size 64M
perf_dealloc_max_wait_time 1500
perf_store_wait_time 5s
perf_store_max_wait_time 10m
perf_session_opt_num_checks 1000000000 1000 500 200 100
perf_fpc_opt_num_checks 1000000000 1000 500 200 100
perf_session_opt_num_comp_attempts 1000000000 100 25 10 0
perf_fpc_opt_num_comp_attempts 1000000000 100 25 10 0
perf_session_opt_retain_counts 1 2 2 250
perf_fpc_opt_retain_counts 1 2 50 100
perf_session_unlinking_quotas 16 256
perf_fpc_unlinking_quotas 64 1024
perf_num_internal_tag_refs 1
perf_thread_wait_quit_time 3000
perf_session_table_fill_factor 1.5
perf_fpc_table_fill_factor 1.5
perf_tags_table_fill_factor 1.5
perf_session_init_table_capacity 4096
perf_fpc_init_table_capacity 8192
perf_tags_init_table_capacity 256
perf_session_opt_queue_capacity 32
perf_fpc_opt_queue_capacity 32
perf_session_opt_max_queue_capacity 1024
perf_fpc_opt_max_queue_capacity 1024
perf_session_store_queue_capacity 32
perf_fpc_store_queue_capacity 32
perf_session_store_max_queue_capacity 1024
perf_fpc_store_max_queue_capacity 2048
perf_tag_manager_queue_capacity 32
perf_tag_manager_max_queue_capacity 16384
perf_log_queue_capacity 8
perf_log_max_queue_capacity 1024
perf_session_binlog_queue_capacity 64
perf_session_binlog_max_queue_capacity 512
perf_fpc_binlog_queue_capacity 64
perf_fpc_binlog_max_queue_capacity 512
perf_binlog_loader_queue_capacity 4
perf_binlog_loader_max_queue_capacity 16
perf_listener_input_queue_capacity 64
perf_listener_input_queue_max_capacity 64
perf_listener_output_queue_capacity 64
perf_listener_output_queue_max_capacity 64
perf_session_replicator_queue_capacity 32
perf_session_replicator_max_queue_capacity 32
perf_fpc_replicator_queue_capacity 32
perf_fpc_replicator_max_queue_capacity 32
perf_session_replicator_local_queue_capacity 16
perf_session_replicator_local_max_queue_capacity 1024
perf_fpc_replicator_local_queue_capacity 16
perf_fpc_replicator_local_max_queue_capacity 1024
perf_config_queue_capacity 8
perf_config_max_queue_capacity 256
session_optimization_compressors zlib zstd
fpc_optimization_compressors zlib zstd
"""
#: Counters by domain mask (global 1, session 2, FPC 4).
COUNTERS = {
    7: """
        Shared_Header_Size Shared_Header_Reallocations Waits_Until_No_Readers Local_Queue_Put_Failures Local_Queue_Reallocations
        Local_Queue_Max_Capacity Queue_Put_Waits Queue_Failed_Reallocations Queue_Capacity_Reductions Queue_Forced_Reallocations Queue_Reallocations
        Queue_Max_Capacity Cache_Misses Cache_Hits IO_Objects_Cloned IO_Objects_Copied IO_Objects_Created IO_Objects_Active List_Add_Failures
        List_Miscalculations List_Short_Reallocs List_Medium_Reallocs List_Long_Reallocs List_Completed_Reallocs List_Added_Strings
        Store_Objects_Name_Length Store_Objects_Length Store_Objects_Active Store_Objects_Created Replicator_Max_Deferred_Commands
        Replicator_Deferred_Commands Replicator_Reconnections Memory_Max_Used Memory_Realloc_Purges Memory_Calloc_Purges Memory_Alloc_Purges
        Memory_Realloc_Range Memory_Opt_Calloc_Range Memory_Calloc_Range Memory_Alloc_Range Memory_Free_Calls Memory_Realloc_Calls
        Memory_Opt_Calloc_Calls Memory_Calloc_Calls Memory_Alloc_Calls SpinLock_Max_Waits SpinLock_Total_Waits SpinLock_Acquisitions
        Pipeline_Connection_Events Pipeline_Object_Events Pipeline_Socket_Events Pipeline_Queue_Events
    """,
    1: """
        Recompressions_Failed Recompressions_Succeeded Sockets_Accept_Error_Other Sockets_Accept_Error_IP Sockets_Accept_Error_Address
        Sockets_Accept_Try_NoConn Sockets_Closed Sockets_Received_Data_Range Sockets_Sent_Data_Range Socket_Inbound_Connections
        Socket_Outbound_Connections Sockets_Bound Sockets_Created Socket_Hosts_Resolved Hash_Object_Waits Hash_Object_Lock_Try_Failures
        Hash_Object_Lock_Try_Successes Hash_Object_Locks Incoming_Connections
    """,
    4: """
        Store_Tag_Array_Reallocs Store_Tags_Per_Object
    """,
    2: """
        Session_Aborted_Locks Session_Broken_Locks Session_Lock_Waits
    """,
}


def options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x.split(" ", 1)) for x in OPTIONS.strip().split("\n")], "name string, value string")


def counters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, mask) for mask, names in COUNTERS.items() for n in names.split()], "name string, domains int")


def masks(spark: SparkSession, given: list[str]) -> DataFrame:
    return spark.createDataFrame([(m,) for m in given], "mask string").withColumn("pattern", scalars.mask_pattern(F.col("mask")))


def latest(log: DataFrame) -> DataFrame:
    """SET commands (seq, name, value) to the options' last values."""
    last = Window.partitionBy("name").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("name", "value")
