import numpy as np

from upshot.functions import distributions as D


def test_t_two_sided_table_values():
    # two-sided 5 % critical values of Student's t (published tables)
    for df, crit in [(1, 12.706204736), (8, 2.306004135), (30, 2.042272456)]:
        assert abs(D.t_two_sided(crit, df) - 0.05) < 1e-7
    assert D.t_two_sided(0.0, 5) == 1.0


def test_chi2_and_normal():
    assert abs(D.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(D.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(D.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(D.normal_ppf(0.975) - 1.959963984540054) < 1e-9
    assert abs(D.normal_ppf(0.8) - 0.8416212335729143) < 1e-9
    assert np.isnan(D.t_two_sided(np.nan, 3))


def test_betainc_symmetry():
    x = np.linspace(0.01, 0.99, 25)
    a, b = 2.5, 4.0
    assert np.allclose(D.betainc(a, b, x) + D.betainc(b, a, 1 - x), 1.0, atol=1e-12)
