"""Column-parameterised DataFrame operators for variant-effect and perturbation-screen analytics."""
