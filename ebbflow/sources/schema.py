"""Canonical demand schema, raw-header aliases and column defaults."""

from __future__ import annotations

# The 35 canonical columns of the demand history, in order.
CANONICAL_COLUMNS = [
    "order_id", "order_date", "customer_id", "city", "product_id", "product_name", "category",
    "order_qty", "revenue", "order_year", "order_month", "order_day", "order_day_of_week",
    "is_late", "channel_Retail", "delivery_status_Late delivery", "delivery_status_Late or partial",
    "delivery_status_On-time full", "delivery_status_Shipping canceled", "delivery_status_Shipping on time",
    "customer_type_Enterprise", "country_USA", "city_encoded", "category_encoded",
    "forecast_date", "base_demand_qty", "promotional_demand_qty", "is_promotional",
    "promo_type", "discount_percent", "price", "temperature", "humidity", "inflation", "location",
]

# Raw header -> canonical name (first matching source column wins).
RAW_ALIASES = {
    "Order Id": "order_id", "order_id": "order_id", "transaction_id": "order_id",
    "order date (DateOrders)": "order_date", "Order Date": "order_date", "order_date": "order_date",
    "transaction_date": "order_date", "date": "order_date", "forecast_date": "order_date",
    "weather_date": "order_date", "promo_start_date": "order_date", "alert_date": "order_date",
    "created_date": "order_date", "last_updated": "order_date", "start_date": "order_date",
    "Order Customer Id": "customer_id", "customer_id": "customer_id", "customer": "customer_id",
    "Order City": "city", "city": "city", "location": "city",
    "Product Card Id": "product_id", "product_id": "product_id", "sku_id": "product_id",
    "Product Name": "product_name", "product_name": "product_name",
    "Category Name": "category", "category": "category",
    "Order Item Quantity": "order_qty", "order_qty": "order_qty", "total_demand_qty": "order_qty",
    "Sales": "revenue", "revenue": "revenue", "pos_sales_value": "revenue", "total_revenue": "revenue",
    "Delivery Status": "delivery_status",
    "Order Country": "country", "country": "country",
    "customer_name": "customer_id", "customer_code": "customer_id",
    "city_code": "city",
    "product_code": "product_id",
    "variant": "category",
    "order_quantity": "order_qty", "qty_ordered": "order_qty", "quantity": "order_qty",
    "sales_amount": "revenue", "net_sales": "revenue", "gross_sales": "revenue",
    "order_placement_date": "order_date", "delivery_date": "order_date",
    "agreed_delivery_date": "order_date", "actual_delivery_date": "order_date",
    "delivery_time_days": "is_late",
    "month": "order_month", "year": "order_year", "week_no": "order_day_of_week",
}

# Date candidates, in order of preference.
DATE_CANDIDATES = ["order_date", "date", "order_placement_date", "agreed_delivery_date",
                   "actual_delivery_date"]

# Columns defaulted to 0.0 / False when a source lacks them.
ZERO_DEFAULT = ["order_qty", "revenue", "order_year", "order_month", "order_day", "order_day_of_week",
                "city_encoded", "category_encoded", "base_demand_qty", "promotional_demand_qty",
                "discount_percent", "price", "temperature", "humidity", "inflation"]
FALSE_DEFAULT = ["is_late", "is_promotional"]

# The reference-table files of a data folder.
REFERENCE_TABLES = ["customer", "sku", "weather", "external_factors", "promo_calendar",
                    "inventory_snapshots", "alerts", "scenarios"]

CRITICAL_COLUMNS = ["order_id", "order_date", "product_id", "order_qty", "revenue"]
NUMERIC_COLUMNS = ["order_qty", "revenue"]
