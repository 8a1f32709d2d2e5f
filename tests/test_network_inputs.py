from linkrisk.plans import stored


def test_network_job_stores_only_the_collisions_of_its_year(spark):
    rows = stored._yearly_inputs(spark, "/root/testdata/sf0.001", (1996,), reported=(1996,))[0]
    every = stored._yearly_inputs(spark, "/root/testdata/sf0.001", (1996,))[0]
    assert {r[0] for r in rows.select("collision_year").distinct().collect()} == {1996}
    assert rows.exceptAll(every.where("collision_year = 1996")).isEmpty() and rows.count() == every.where("collision_year = 1996").count() < every.count()
