"""Table-in, table-out operators (cleaning, catalogue, daily aggregate, registry, analytics, alerts, features, forecasting, context, exports)."""
