from tabstat.functions.dist import (  # noqa: F401
    chi2_sf,
    f_sf,
    kolmogorov_sf,
    norm_cdf,
    norm_cdf_sql,
    norm_ppf,
    norm_ppf_sql,
    phi,
    phi_inv,
    t_ppf,
    t_sf,
    t_two_sided_p,
)
from tabstat.functions.exprs import (  # noqa: F401
    bin_index,
    boxcox_expr,
    right_closed_bins,
    safe_div,
)
