"""Session settings and the work folder."""

import pytest

from rulewatch.session import SETTINGS, work_dir


def test_settings_are_in_force(spark):
    assert {k: spark.conf.get(k) for k in SETTINGS} == SETTINGS


def test_the_work_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured and work_dir(spark) == configured == work_dir(spark)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        work_dir(Session())
