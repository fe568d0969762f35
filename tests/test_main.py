import os

from tessera.__main__ import main

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "orders", "product.yaml")


def test_job_entry_point_commands(spark, root, capsys):
    out = main(["run", FIXTURE, "--root", root], spark=spark)
    assert out["version"] == 1 and out["grain"][0]["distinct_grain"] == 4
    assert main(["release", FIXTURE, "--root", root], spark=spark)["pins"] == {"orders_daily@2": 1}
    page = main(["read", FIXTURE, "--root", root, "orders_daily@2", "region=north", "limit=1"], spark=spark)
    assert page == [{"order_date": "2025-03-01", "region": "north", "revenue": 20.0}]
    assert all(v["ok"] for v in main(["verify", FIXTURE, "--root", root], spark=spark))
    assert main(["status", FIXTURE, "--root", root], spark=spark)["status"] == "verified"
    main(["run", FIXTURE, "--root", root], spark=spark)
    assert main(["rollback", FIXTURE, "--root", root], spark=spark)["to"] == 1
    assert len(main(["history", FIXTURE, "--root", root], spark=spark)) == 4
    assert '"orders_daily@2"' in capsys.readouterr().out


def test_context_and_expire_commands(spark, root):
    main(["run", FIXTURE, "--root", root], spark=spark)
    ctx = main(["context", FIXTURE, "--root", root], spark=spark)
    assert ctx["execution"] == 1 and [e["route"] for e in ctx["exports"]] == ["orders_daily@2", "orders_latest@1"]
    main(["run", FIXTURE, "--root", root], spark=spark)
    out = main(["expire", FIXTURE, "--root", root, "--retention-days", "0"], spark=spark)
    assert out["expired_versions"] == [1]
