SELECT n_nationkey, n_name FROM __THIS__
