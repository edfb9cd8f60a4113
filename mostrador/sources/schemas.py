"""Column types of the shop's tables, as Spark DDL.

Passwords and session tokens are left out on purpose: no report needs them.
"""

TABLES = {
    "users": "iduser BIGINT, user STRING, email STRING, fecha_nacimiento DATE, sexo STRING, foto STRING, "
             "estado STRING, idrol INT, created_at TIMESTAMP_NTZ",
    "producto": "idproducto BIGINT, iduser BIGINT, p_producto DECIMAL(12,2), nomprod STRING, clave STRING, "
                "descripcion STRING, foto STRING, foto2 STRING, foto3 STRING, descuento DECIMAL(5,2), "
                "p_final DECIMAL(14,4), tipo_personalizacion STRING, created_at TIMESTAMP_NTZ",
    "compra": "idcompra BIGINT, total DECIMAL(14,2), fecha TIMESTAMP_NTZ, iduser BIGINT, idproducto BIGINT, "
              "cantidad INT",
    "compra_detalle": "iddetalle BIGINT, idcompra BIGINT, idproducto BIGINT, cantidad INT, total DECIMAL(14,2)",
    "compras": "idcompra BIGINT, iduser BIGINT, productos STRING, total DECIMAL(14,2), fecha TIMESTAMP_NTZ",
    "compras_detalle": "iddetalle BIGINT, idcompra BIGINT, productos STRING, total DECIMAL(14,2), "
                       "codigoCupon STRING",
    "comentarios": "idproducto BIGINT, iduser BIGINT, comentario STRING, calificacion DECIMAL(3,1), "
                   "fecha TIMESTAMP_NTZ",
    "cupones": "idcupon BIGINT, porcentaje DECIMAL(5,2), codigo STRING, fecha_expiracion TIMESTAMP_NTZ, "
               "usos_maximos INT, usos_actuales INT, activo BOOLEAN, descripcion STRING",
    "user_cupones": "iduser BIGINT, idcupon BIGINT, fecha_reclamacion TIMESTAMP_NTZ",
    "cupones_usados": "iduser BIGINT, idcupon BIGINT, fecha_uso TIMESTAMP_NTZ",
    "detalle_entrega": "identrega BIGINT, idcompra BIGINT, pais STRING, nombre STRING, apellidos STRING, "
                       "direccion STRING, colonia STRING, codigo_postal STRING, ciudad STRING, estado STRING, "
                       "telefono STRING",
    "detalle_personalizacion": "idpersonalizacion BIGINT, idcompra BIGINT, lado_frontal STRING, "
                               "lado_trasero STRING, foto STRING, foto2 STRING",
    "personalizaciones": "idpersonalizacion BIGINT, idproducto BIGINT, texto_personalizado STRING, "
                         "imagen_personalizada STRING, color STRING",
    "visitas_por_mes": "mes STRING, numero_de_visitas BIGINT",
    "paypal_logs": "order_id STRING, status STRING, iduser BIGINT, total DECIMAL(14,2), currency STRING, "
                   "description STRING, details STRING, ts TIMESTAMP_NTZ",
    "rol": "idrol INT, nomrol STRING",
    "permiso": "idpermiso INT, nompermiso STRING, clave STRING",
    "rolxpermiso": "idrol INT, idpermiso INT",
    "emails": "idemail BIGINT, nombre STRING, asunto STRING, correo STRING, mensaje STRING",
    "carrusel": "idfoto BIGINT, foto STRING",
}

# One order request as the shop front sends it. Line fields are read as text because
# writers quote numbers freely; see functions.lines for the typed form.
ORDER_REQUEST = (
    "idcompra BIGINT, fecha TIMESTAMP_NTZ, iduser BIGINT, codigoCupon STRING, "
    "productos ARRAY<STRUCT<idproducto:STRING, cantidad:STRING, talla:STRING, tipo_personalizacion:STRING>>, "
    "detalleEntrega STRUCT<pais:STRING, nombre:STRING, apellidos:STRING, direccion:STRING, colonia:STRING, "
    "codigo_postal:STRING, ciudad:STRING, estado:STRING, telefono:STRING>, "
    "detallePersonalizacion STRUCT<lado_frontal:STRING, lado_trasero:STRING, foto:STRING, foto2:STRING>"
)
