"""Short column descriptions, in our own words, for the data dictionary.

Columns that come in families are described by rule. Installations with better texts pass their
own table to ``inspection.dictionary``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobharbor import schemas

TIMES = {
    "creationtime": "created", "modificationtime": "last changed", "statechangetime": "last changed state",
    "proddbupdatetime": "last copied to the production database", "starttime": "started", "endtime": "ended",
}
MEMORY = {"rss": "resident", "vmem": "virtual", "swap": "swap", "pss": "proportional"}

SINGLE = {
    "pandaid": "Id of the job; the key of the table.",
    "jobdefinitionid": "Id of the definition the job was made from.",
    "schedulerid": "Scheduler that submitted the job.",
    "pilotid": "Pilot that ran the job.",
    "taskid": "Task of the job.",
    "jeditaskid": "Task of the job in the task manager.",
    "reqid": "Request behind the task.",
    "jobsetid": "Set of jobs submitted together.",
    "workqueue_id": "Work queue used for scheduling.",
    "computingsite": "Queue the job was assigned to.",
    "computingelement": "Computing element within the site.",
    "nucleus": "Main site of the task.",
    "wn": "Worker node.",
    "transformation": "Program the job runs.",
    "container_name": "Container image.",
    "produserid": "Who submitted the job.",
    "gshare": "Share the job is charged to.",
    "resourcetype": "Class of cores and memory asked for.",
    "attemptnr": "Number of this attempt.",
    "maxattempt": "Attempts allowed.",
    "failedattempt": "Attempts that failed.",
    "jobstatus": "State of the job.",
    "jobsubstatus": "Detail of the state.",
    "transexitcode": "Exit code of the program.",
    "transformerrordiag": "What the program reported about its failure.",
    "error_desc": "All errors in words.",
    "errorinfo": "All errors in short form.",
    "corecount": "Cores asked for.",
    "actualcorecount": "Cores given.",
    "cpuefficiency": "Processor time over wall time and cores.",
    "cpuconsumptiontime": "Processor time used.",
    "maxpssgbpercore": "Highest proportional memory per core in GB.",
    "nevents": "Events processed.",
    "durationsec": "Run time in seconds.",
    "durationmin": "Run time in minutes.",
    "duration": "Run time as text.",
    "waittimesec": "Time before the start in seconds.",
    "waittime": "Time before the start as text.",
    "pilotversion": "Version of the pilot.",
    "jobmetrics": "Further measurements as text.",
    "creationhost": "Machine from which the job was created.",
    "modificationhost": "Machine that changed the record last.",
    "atlasrelease": "Software release asked for.",
    "homepackage": "Package and version of the program.",
    "cmtconfig": "Platform the software was built for.",
    "cpu_architecture_level": "Instruction set level the job needs.",
    "prodserieslabel": "Production series.",
    "prodsourcelabel": "Kind of work the job belongs to.",
    "grid": "Grid the queue is part of.",
    "cloud": "Region the queue is part of.",
    "homecloud": "Region the job came from.",
    "transfertype": "How input and output are moved.",
    "eventservice": "Whether single events are handed out, and how.",
    "job_label": "Label given at submission.",
    "category": "Category used in reports.",
    "lockedby": "Process that holds the job.",
    "relocationflag": "Whether the job may be moved elsewhere; 0 is no.",
    "jobname": "Name given at submission.",
    "ipconnectivity": "Network access the job needs.",
    "processor_type": "Kind of processor, such as CPU or GPU.",
    "assignedpriority": "Priority at submission.",
    "currentpriority": "Priority now.",
    "priorityrange": "Band the priority falls into.",
    "jobsetrange": "Band the job set falls into.",
    "commandtopilot": "Order waiting for the pilot.",
    "proddblock": "Dataset the input comes from.",
    "dispatchdblock": "Dataset that carries the input to the site.",
    "destinationdblock": "Dataset the output goes to.",
    "destinationse": "Storage the output goes to.",
    "sourcesite": "Site the input comes from.",
    "destinationsite": "Site the output goes to.",
    "maxcpucount": "Processor time allowed.",
    "maxcpuunit": "Unit of the processor time allowed.",
    "maxdiskcount": "Disk space allowed.",
    "maxdiskunit": "Unit of the disk space allowed.",
    "minramcount": "Memory asked for.",
    "minramunit": "Unit of the memory asked for.",
    "meancorecount": "Cores in use on average.",
    "maxwalltime": "Run time allowed.",
    "cpuconsumptionunit": "Processor model or unit behind the time used.",
    "cpuconversion": "Factor to normalise processor time.",
    "hs06": "Benchmark score of the cores.",
    "hs06sec": "Processor time weighted by the benchmark score.",
    "totrchar": "Characters read in all.",
    "totwchar": "Characters written in all.",
    "totrbytes": "Bytes read from storage in all.",
    "totwbytes": "Bytes written to storage in all.",
    "raterchar": "Characters read a second.",
    "ratewchar": "Characters written a second.",
    "raterbytes": "Bytes read from storage a second.",
    "ratewbytes": "Bytes written to storage a second.",
    "diskio": "Rate of disk traffic.",
    "memoryleak": "Growth of memory fitted over the run.",
    "memoryleakx2": "Quality of that fit.",
    "ninputdatafiles": "Input files.",
    "inputfiletype": "Type of the input data.",
    "inputfileproject": "Project of the input data.",
    "inputfilebytes": "Size of the input in bytes.",
    "noutputdatafiles": "Output files.",
    "outputfilebytes": "Size of the output in bytes.",
    "outputfiletype": "Type of the output data.",
    "gco2_regional": "Grams of carbon dioxide by the region's power mix.",
    "gco2_global": "Grams of carbon dioxide by the world's power mix.",
    "jobinfo": "Further facts about the job as text.",
    "consumer": "Consumer the events were handed to.",
    "field": "Facet being summarised.",
    "list_json": "Values of the facet with their job counts.",
    "stats_json": "Totals of the facet.",
    "error": "Component that reported the error.",
    "codename": "Name of the error code.",
    "codeval": "Error code.",
    "diag": "Message that came with the code.",
    "error_desc_text": "Meaning of the code.",
    "example_pandaid": "One job with this error.",
    "count": "Jobs with this error.",
    "pandalist_json": "All jobs with this error.",
    "_queue": "Queue the row was fetched for.",
    "_fetched_utc": "Time of the fetch that last wrote the row, in UTC.",
    "id": "Position in the response of the queue, from 0.",
}


#: Fields of the queue catalogue that most queues carry; others have no description unless a table of them is passed.
CATALOGUE = {
    "queue": "Name of the queue; the key of the table.",
    "status": "Whether the queue takes work.",
    "cloud": "Region the queue is part of.",
    "country": "Country of the site.",
    "corecount": "Cores a job of the queue gets.",
    "corepower": "Benchmark score of a core.",
    "maxrss": "Memory a job may use, in MB.",
    "nodes": "Worker nodes.",
    "allow_lan": "Whether jobs may read over the local network.",
    "availablecpu": "Cores available.",
    "pledgedcpu": "Cores pledged.",
    "astorages": "Storages by activity, as JSON.",
    "params": "Further settings, as JSON.",
    "hc_suite": "Test suites that probe the queue, as JSON.",
    "queues": "Computing elements behind the queue, as JSON.",
    "copytools": "Transfer tools and their settings, as JSON.",
    "data": "An entry that is no object, as it came.",
}


def describe_column(name: str) -> str:
    if name in SINGLE:
        return SINGLE[name]
    if name in TIMES:
        return f"When the job was {TIMES[name]}, in UTC." if name == "creationtime" else f"When the job {TIMES[name]}, in UTC."
    for component in schemas.ERROR_COMPONENTS:
        if name == f"{component}errorcode":
            return f"Error code of the {component} component; 0 is none."
        if name == f"{component}errordiag":
            return f"Message of the {component} component."
    for prefix, measure in (("max", "Highest"), ("avg", "Average")):
        for kind, word in MEMORY.items():
            if name == prefix + kind:
                return f"{measure} {word} memory in kB."
    return ""


def default_descriptions(spark: SparkSession) -> DataFrame:
    rows = [
        (table, column, describe_column(column))
        for table, schema in schemas.TABLES.items()
        for column in schema.names
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, description string")
